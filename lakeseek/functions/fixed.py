"""Results depend on them being exactly these."""

# Directories never read, at any depth.
SKIP_DIRS = (".git", "node_modules", "venv", ".venv", "__pycache__", "dist", "build")
# Files larger than this are skipped; a NUL in the first bytes marks a binary file.
MAX_FILE_BYTES, SNIFF_BYTES = 1_000_000, 8192
# A file of this many characters with lines longer than this on average is minified.
MINIFIED_CHARS, MINIFIED_LINE_CHARS = 2000, 300

# Language by file suffix.
LANGUAGES = {
    ".py": "python",
    ".pyi": "python",
    ".js": "javascript",
    ".mjs": "javascript",
    ".cjs": "javascript",
    ".jsx": "javascript",
    ".ts": "typescript",
    ".tsx": "typescript",
    ".java": "java",
    ".kt": "kotlin",
    ".scala": "scala",
    ".c": "c",
    ".h": "c",
    ".cc": "cpp",
    ".cpp": "cpp",
    ".cxx": "cpp",
    ".hpp": "cpp",
    ".cs": "csharp",
    ".go": "go",
    ".rs": "rust",
    ".rb": "ruby",
    ".php": "php",
    ".swift": "swift",
    ".m": "objective-c",
    ".dart": "dart",
    ".lua": "lua",
    ".r": "r",
    ".pl": "perl",
    ".sh": "shell",
    ".bash": "shell",
    ".ps1": "powershell",
    ".sql": "sql",
    ".html": "html",
    ".css": "css",
    ".scss": "scss",
    ".vue": "vue",
    ".md": "markdown",
    ".rst": "rst",
    ".json": "json",
    ".yaml": "yaml",
    ".yml": "yaml",
    ".toml": "toml",
    ".xml": "xml",
}

# File kinds by directory, suffix and stem.
TEST_DIRS = ("test", "tests", "testing", "__tests__", "spec", "specs")
DOCS_DIRS = ("doc", "docs", "documentation")
DOCS_SUFFIXES = (".md", ".rst", ".txt", ".adoc", ".rdoc")
DOCS_STEMS = ("readme", "changelog", "changes", "history", "license", "licence", "contributing", "authors", "notice", "news")

# Words that never are search terms.
STOPWORDS = tuple(
    (
        "a an and are as at be by can could do does done for from how i if in into is it its me my of on or should so that the their there "
        "this to was we what when where which who why will with would you your implement implemented implementation work works"
    ).split()
)
TERM_CHARS, TERM_MIN = 5, 3
# A line that defines something. No lookaround, so that Java, Python and RE2 agree.
DEFINITION = (
    r"^\s*(?:@|(?:async\s+)?def\s|class\s|(?:export\s+)?(?:async\s+)?function\b|[\w.]+\s*=\s*(?:async\s+)?function\b"
    r"|(?:export\s+)?(?:const|let|var)\s+\w+\s*=\s*(?:async\s*)?\()"
)
SNIPPET_LINES, LOOK_BACK = 12, 6

# Chunking: budget of a context header in tokens and what its lines may add, overlap of windows, sizes of syntax chunks.
HEADER_TOKENS, HEADER_SLACK, OVERLAP_TOKENS = 64, 2, 128
AST_TARGET, AST_MINIMUM, AST_OVERLAP = 500, 200, 64

# Search and evaluation.
CHUNKS_PER_DOC, KIND_PENALTY, EVAL_DEPTH, RRF_K = 3, 0.05, 100, 60
PRF_DOCS = (1, 2, 3, 5, 10, 20)
PRF_ALPHAS = (0.05, 0.1, 0.2, 0.3, 0.5, 0.75, 1.0, 1.5, 2.0)
PRF_LEAST_GAIN = 0.005
LENGTH_LIMITS = (256, 512, 1024, 2048, 4096, 8192)
