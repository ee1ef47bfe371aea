"""Cases where an operator once did less than the whole job."""

import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa

from lakeseek.llm import class_lm, merkle
from lakeseek.llm import decontaminate as decontaminate_module
from lakeseek.llm.decontaminate import contaminated
from lakeseek.llm.html_extract import Page, extract, path_scores


def prints(texts):
    return [merkle.fingerprint(t) for t in merkle.trees(pa.array(texts, pa.large_string()))]


def test_merkle_copies_among_different_neighbours():
    words = [f"w{i * 7919 % 1000}" for i in range(4000)]
    copies = [" ".join(words[5 * k : 5 * k + 20]) + "\n" + " ".join(words[5 * k + 20 : 5 * k + 40]) for k in range(100)]
    among = lambda before, after: prints([x for c in copies for x in (before, c, after)])[1::3]
    alone = [prints([c])[0] for c in copies]
    assert among("", "") == among("one two three four", "five six seven") == among("eight\nnine", "\nten") == alone
    # equal paragraphs have equal leaves and digests, whatever stands around them
    for c in copies:
        own = [p for x in c.split("\n") for _, section in merkle.parsed(prints([x])[0])[1] for p in section]
        assert [p for _, section in merkle.parsed(prints([c])[0])[1] for p in section] == own


def test_merkle_tree_by_hand():
    """The tree put together from the definition, and likeness as the share of leaves in equal branches."""
    import hashlib

    rng = np.random.default_rng(4)
    sha = lambda x: hashlib.sha256(x).digest()
    texts = ["", "\n", " a \n\n b", "one"] + ["\n".join(" ".join(f"w{x}" for x in rng.integers(0, 50, rng.integers(0, 30))) for _ in range(rng.integers(1, 12))) for _ in range(40)]
    grown = merkle.trees(pa.array(texts, pa.large_string()))
    for text, (root, sections) in zip(texts, grown):
        lines = text.encode().split(b"\n")
        assert sum(len(ps) for _, ps in sections) == len(lines)
        assert root == sha(b"".join(s for s, _ in sections)).hex()
        at = 0
        for s, ps in sections:
            assert s == sha(b"".join(p for p, _ in ps))
            for k, (p, leaves) in enumerate(ps):
                # cut the line's bytes wherever its leaves say, by trying all word starts
                line, digests, lo = lines[at], [], 0
                for i in range(len(leaves) // 3):
                    ends = [len(line)] if i + 1 == len(leaves) // 3 else range(lo + 1, len(line))
                    hi = next(e for e in ends if sha(line[lo:e])[:3] == leaves[3 * i : 3 * i + 3])
                    digests.append(sha(line[lo:hi]))
                    lo = hi
                assert p == sha(b"".join(digests)) and lo == len(line)
                closes = p[4] & 7 == 0 or not line.strip()
                assert closes == (k + 1 == len(ps)) or at + 1 == len(lines)
                at += 1
    bag = lambda t: Counter(leaves[i : i + 3] for _, ps in t[1] for _, leaves in ps for i in range(0, len(leaves), 3))
    for a, b in zip(range(40), rng.integers(0, len(texts), 40)):
        x, y = bag(grown[a]), bag(grown[b])
        want = 1.0 if texts[a] == texts[b] else 2 * sum((x & y).values()) / (sum(x.values()) + sum(y.values()))
        got = merkle.likeness(*(merkle.fingerprint(grown[i]) for i in (a, b)))
        assert abs(got - want) < 1e-12 and got == merkle.tree_likeness(grown[a], grown[b])


PARTS = ["A heading of the page", *[f"Sentence number {i} of the article, long enough to be text, has commas, and an end." for i in range(6)]]
ARTICLE = f"<h1>{PARTS[0]}</h1>" + "".join(f"<p>{p}</p>" for p in PARTS[1:])
TEXT = "\n".join(PARTS)


def test_html_self_closed_svg_and_math():
    for icon in ('<svg class="a>b" viewBox="0 0 1 1"/>', "<svg/>", "<svg hidden />", "<math/>", '<math display="block"/>', "<svg a='1'><title>no</title><path d='M0'/></svg>"):
        assert extract(f"<body><article>{icon}{ARTICLE}</article><svg><text>no</text></svg></body>") == TEXT, icon
    assert extract("<article><p>So <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds.</p></article>") == "So x=2 holds."


def test_html_wrappers_named_after_what_stands_beside():
    side = '<div class="sidebar"><p>Other things to read, and more, and more of them.</p></div>'
    comments = '<div id="comments">' + "".join(f"<p>I, for one, think that remark {i} is right, and well put, too.</p>" for i in range(40)) + "</div>"
    for name in ("content with-sidebar", "no-sidebar", "has-comments", "content sidebar-left", "page comments-open", "withSidebar"):
        for inner in (ARTICLE, f"<article>{ARTICLE}</article>"):
            assert extract(f"<body><nav>menu</nav><div class='{name}'>{inner}{side}</div></body>") == TEXT, name
    assert extract(f"<body><div class='entry'>{ARTICLE}</div>{side}{comments}</body>") == TEXT
    assert extract(f"<body><div class='entry has-comments'>{ARTICLE}{comments}</div>{side}</body>") == TEXT
    assert extract(f"<body><div class='ad'>{'Buy this, and that. ' * 9}</div><article><h1>Short</h1></article></body>") == "Short"
    assert extract("<div class='footer'><nav>a</nav></div>") == ""


GOOD = "".join(f"<p>Good paragraph {i}, which says something, and more of it.</p>" for i in range(2))
GOOD_TEXT = "\n".join(f"Good paragraph {i}, which says something, and more of it." for i in range(2))


def test_html_names_count_as_a_whole():
    for start in (
        'div class="layout has-sidebar"', 'div class="with-sidebar"', 'article class="post share-enabled"', 'main class="side-by-side"', 'article class="notice-board"',
        'article class="article legal-news"', 'div class="comment-free"', 'form id="page"', 'div style="display:none" class="content"',
    ):
        page = f"<html><body><nav><a>x</a></nav><{start}>{GOOD}</{start.split()[0]}><footer>f</footer></body></html>"
        assert extract(page) == GOOD_TEXT, start
    for name in ("site-footer", "cookie-notice", "sidebar", "related-posts", "comment-list", "socialShare", "ad"):
        assert extract(f"<body><div>{GOOD}</div><div class='x {name}'><p>Other things to read, and more.</p></div></body>") == GOOD_TEXT, name


def test_html_keeps_every_article_and_fallbacks():
    assert extract(f"<article><h2>One</h2>{GOOD}</article><article><p>Short one.</p></article>") == f"One\n{GOOD_TEXT}\nShort one."
    assert extract("<p>See <object>the object</object> and <noscript>this</noscript> text <canvas>here</canvas>.</p>") == "See the object and this text here."
    assert extract(f"<div>{GOOD}<ul><li>tea</li><li>salt</li></ul>{GOOD}</div>") == f"{GOOD_TEXT}\ntea\nsalt\n{GOOD_TEXT}"


def test_html_time_grows_with_the_page():
    import time

    for piece in ("<div>x", "<a ", "<a x='", "<a x=\">\"", "<p><b><i>", "</p>", "<!--", "<table><tr><td>x", "<svg", "<script>", "<li>", "&amp", "<div></b>", "=\"'>"):
        began = time.perf_counter()
        extract(piece * (300_000 // len(piece)))
        assert time.perf_counter() - began < 5, piece


def test_tag_path_scores_by_hand():
    """Ratios, smoothing and fusion written out from the tags themselves."""
    page = Page("<body><ul><li>a</li><li>bb</li></ul><div><p>Some words, here.</p><p>More; of them!</p><span>in</span><p>x</p></div></body>")
    tags = lambda e: "" if not e else tags(page.parent[e]) + "/" + page.tag[e]
    texts = [" ".join("".join(t for _, t in pieces).split()) for _, pieces in page.blocks]
    named = [tags(e) for e, _ in page.blocks]
    assert list(zip(named, texts)) == [
        ("/body/ul/li", "a"), ("/body/ul/li", "bb"), ("/body/div/p", "Some words, here."), ("/body/div/p", "More; of them!"), ("/body/div", "in"), ("/body/div/p", "x"),
    ]
    own = {"/body/ul/li": 3 / 2, "/body/div/p": 32 / 3 * (1 + 4 / 3) ** 0.5, "/body/div": 2.0}
    line = [own[n] for n in named]
    at = lambda i: line[min(max(i, 0), 5)]
    smooth = [sum(k * at(i + d) for d, k in zip(range(-2, 3), (1, 4, 6, 4, 1))) / 16 for i in range(6)]
    want = {n: (own[n] * np.mean([s for s, m in zip(smooth, named) if m == n])) ** 0.5 for n in own}
    paths = page.paths([False] * len(page.parent))
    got = path_scores([(paths[e], t) for (e, _), t in zip(page.blocks, texts)])
    assert {n: round(got[paths[e]], 9) for (e, _), n in zip(page.blocks, named)} == {n: round(w, 9) for n, w in want.items()}


def test_decontamination_judges_every_window(spark):
    """Against all windows of all texts: items with parts swapped, shuffled, cut and repeated inside other words."""
    rng = np.random.default_rng(11)
    items = [[f"i{k}w{j % (9 if k == 5 else 1000)}" for j in range(n)] for k, n in enumerate((100, 100, 60, 40, 30, 50, 4))]
    texts = []
    for t in range(70):
        words = items[t % 7]
        cuts = sorted(rng.choice(np.arange(1, len(words)), min(len(words) - 1, int(rng.integers(1, 4))), replace=False))
        parts = [words[a:b] for a, b in zip([0, *cuts], [*cuts, len(words)])]
        order = rng.permutation(len(parts)) if t % 3 else range(len(parts))
        body = [w for i in order for w in (*parts[i], *[f"x{t}"] * int(rng.integers(0, 2)))]
        texts.append([f"a{t}_{i}" for i in range(int(rng.integers(0, 80)))] + body + [f"b{t}_{i}" for i in range(int(rng.integers(0, 80)))])
    swapped = [f"c{i}" for i in range(60)] + items[0][50:] + items[0][:50] + [f"d{i}" for i in range(60)]
    texts.append(swapped)

    def bag(w, k):
        return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))

    want = {}
    for t, w in enumerate(texts):
        for i, item in enumerate(items):
            k, n = min(5, len(item)), len(item)
            b = bag(item, k)
            best = max((sum((a & b).values()) / sum((a | b).values()) for a in (bag(w[s : s + n], k) for s in range(max(1, len(w) - n + 1))) if a), default=0)
            if best >= 0.8 - 1e-9:
                want[t, i] = round(best, 6)
    docs = spark.createDataFrame([(t, " ".join(w)) for t, w in enumerate(texts)], "doc_id bigint, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id bigint, text string")
    found = {(r[0], r.item_id): round(r.similarity, 6) for r in contaminated(docs, bench).collect()}
    assert found == want and (len(texts) - 1, 0) in found


def test_decontamination_broadcasts_only_what_it_counted(spark, monkeypatch):
    """A file of many copies is small, what its rows unfold to is not: no join may be left to the planner, which sees the file."""
    passage = " ".join(f"p{i}" for i in range(30))
    docs = spark.createDataFrame([(i, f"before {passage} after" if i % 5 else f"clean {i}") for i in range(200)] + [(None, passage)], "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, passage)], "item_id bigint, text string")
    plans, write = [], decontaminate_module.materialise

    def recorded(df, label, *by):
        plans.append((label, df._jdf.queryExecution().executedPlan().toString()))
        return write(df, label, *by)

    monkeypatch.setattr(decontaminate_module, "materialise", recorded)
    clean = decontaminate_module.decontaminate(docs, bench, broadcast_rows=0)
    plans.append(("clean", clean._jdf.queryExecution().executedPlan().toString()))
    assert [label for label, plan in plans if "Broadcast" in plan] == []
    assert sorted(r.doc_id for r in clean.collect()) == list(range(0, 200, 5))
    assert sorted(r.doc_id for r in decontaminate_module.decontaminate(docs, bench).collect()) == list(range(0, 200, 5))


class Task:
    """Stands for a DataFrame whose mapInArrow gives the function that a task runs."""

    select = lambda self, *_: self
    mapInArrow = staticmethod(lambda run, _: run)  # noqa: N815


def test_class_lm_neighbours_in_little_memory():
    """A batch of long texts, 20 MB: the same counts as of all tokens, without all of them in memory many times over."""
    rng = np.random.default_rng(5)
    vocabulary = np.array([f"w{i}" for i in range(20_000)])
    texts = [" ".join(vocabulary[(rng.random(4000) ** 2 * 20_000).astype(int)]) for _ in range(900)]
    texts[7], texts[8] = None, ""
    column = pa.array(texts, pa.string())
    known = class_lm._tokens(pa.array(vocabulary[:100].tolist()))[0]
    of = class_lm.Words(known, 1 + np.arange(100) % 7)
    run = class_lm.neighbours(Task(), of, 8)
    tracemalloc.start()
    found = Counter()
    peak = 0
    for part in run([pa.record_batch({class_lm.P + "t": column})]):
        peak = max(peak, tracemalloc.get_traced_memory()[1])
        for h, cell, n in zip(*(part.column(c).to_pylist() for c in ("h", "cell", "n"))):
            found[h, cell] += n
        tracemalloc.reset_peak()
    tracemalloc.stop()
    number = {w: 1 + i % 7 for i, w in enumerate(vocabulary[:100])}
    hashed = dict(zip(vocabulary.tolist(), class_lm._tokens(pa.array(vocabulary.tolist()))[0].view(np.int64).tolist()))
    want = Counter()
    for t in texts:
        line = [None, *(t or "").split(), None]
        for a, w, b in zip(line, line[1:], line[2:]):
            if w not in number:
                for c, shift in ((a, 0), (b, 8)):
                    if c is None or c in number:
                        want[hashed[w], shift + number.get(c, 0)] += 1
    assert found == want
    assert peak < 110e6
