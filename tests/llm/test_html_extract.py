"""Main text by tag-path ratios: the method decides, hostile pages stay cheap, odd tables are defined."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from pedigree.llm import html_extract
from pedigree.llm.html_extract import Ratios, extract, fuse, path_ratios

LONG = "Long text, with many marks and words. And more of it, as it goes on; still on. " * 3
L = LONG.strip()


@pytest.mark.parametrize(
    "page, text",
    [
        (f'<body><div class="content has-sidebar"><p>{L}</p></div>', L),
        (f"<body><form id=f><nav><a href=/>Home</a></nav><article><h1>T</h1><p>{L}</p></article><footer>c, all.</footer></form></body>", f"T\n{L}"),
        (f'<body><article><h1 class="header-title">T</h1><div class="social-study"><p>{L}</p></div><p>{L}</p></article>', f"T\n{L}\n{L}"),
        (f'<body><div><h1>H</h1><p>Lead, short.</p><div class=body>{f"<p>{L}</p>" * 9}</div></div><div class=footer>Copy, right.</div></body>', "\n".join(["H", "Lead, short.", *[L] * 9])),
        (f'<header class="site"><h1>Site</h1></header><article><header class="entry-header"><h1>T</h1></header><p>{L}</p><section class="comments"><h2>Said</h2><div class=comment><p>{L}</p></div></section></article>', f"T\n{L}"),
        (f"<div id=menu>a b c</div><div class=content><h2>H</h2><p>{L}</p><ul><li>one<li>two</ul></div><div class=sidebar><p>{L}</p></div>", f"H\n{L}\none\ntwo"),
        (f"<body><div><a href=x>A</a> <a href=y>B</a></div><div><h1>T</h1><p>{L}</p><h2>S</h2><p>Ok.</p></div><div>Copyright, me.</div></body>", f"T\n{L}\nS\nOk."),
        (f'<div class="cookie-notice"><p>We use cookies, ok? {L}</p></div><main><h1>T</h1><p>{L}</p><form><label>Mail</label></form><aside><p>{L}</p></aside></main>', f"T\n{L}"),
        (f'<article><p>One, <a href=x>two</a> <span class="share">Share</span> three. {L}</p></article>', f"One, two three. {L}"),
        (f"<article><p>{L}<svg/>{L}<svg><text>no</text></svg></p><p title='a>b'>x</p></article>", f"{L}{L}\nx"),
    ],
)
def test_pages(page, text):
    assert extract(page) == text


@pytest.mark.parametrize(
    "page, text",
    [
        (f'<body><article><h1>T</h1><p>{L}</p></article><ol class="commentlist"><li>{L}</li></ol></body>', f"T\n{L}"),
        (f'<article><h1>T</h1><p>{L}</p><div id="disqus_thread"><p>{L}</p></div><div class="user-comments-list"><p>{L}</p></div></article>', f"T\n{L}"),
        (f"<body><div><div><h1>T</h1><p>{L}</p><p>{L}</p></div><div><h3>More of it</h3><ul><li><a href=x>One page</a><li><a href=y>Two</a></ul><p>A teaser.</p></div></div></body>", f"T\n{L}\n{L}"),
        (f'<article><h1>T</h1><p>{L}</p><div class="search">{L}</div><p class="notice">{L}</p></article>', f"T\n{L}\n{L}\n{L}"),
        (f'<article><h1>T</h1><p>{L}</p><div class="search">Go</div><div><div><div><div><span class=x>9 k</span></div></div></div></div></article>', f"T\n{L}"),
    ],
)
def test_names_do_not_decide(page, text):
    assert extract(page) == text


def test_the_ratios_decide(monkeypatch):
    page = f'<body><nav><a href=a>Home</a></nav><div>Unmarked, short.</div><div class=ad>Buy, now.</div><article><h1>T</h1>{f"<p>{L}</p>" * 6}<p>Be.</p></article><footer>(c) me.</footer></body>'
    body = "\n".join(["T", *[L] * 6, "Be."])
    assert extract(page) == body
    assert extract(page, Ratios(cut=1, prose=1, evidence=0)) == body  # without any name
    assert extract(page, Ratios(threshold=0)) == f"Home\nUnmarked, short.\nBuy, now.\n{body}\n(c) me."
    assert extract(page, Ratios(threshold=1e9)) == ""
    monkeypatch.setattr(html_extract, "fuse", lambda x, y: 1.0)
    assert extract(page) == f"Unmarked, short.\nBuy, now.\n{body}\n(c) me."  # equal ratios let everything in but links


def test_path_ratios_by_hand():
    # path 1 without text, 2 and 3 below it, 4 beside it: (characters, marks, nodes, of links)
    got = path_ratios({2: [30, 3, 3, 0], 3: [100, 5, 1, 0], 4: [7, 0, 1, 0]}, [0, 0, 1, 1, 0])
    assert got[2:] == [(10, 1), (100, 5), (7, 0)] and got[1] == pytest.approx(((30 * 10 + 100 * 100) / 130, (30 * 1 + 100 * 5) / 130))
    assert fuse(10, 1) == 20 and fuse(100, 5) == 600


def _brute(page: str, how: Ratios = Ratios()) -> list[str]:
    """The kept blocks of a page of one <article> in a body, by a table of all prefixes made from the path strings alone; no names are read."""
    blocks = [m for m in re.finditer(r"<(h1|p|li|footer|td)>([^<]*)<", page)]
    paths = []
    for m in blocks:
        stack: list[str] = []
        for close, tag in re.findall(r"<(/?)(\w+)>", page[: m.start(2)]):
            stack.pop() if close else stack.append(tag)
        paths.append("/".join(["#", *stack]))
    own = {}
    for path in dict.fromkeys(paths):
        texts = [m[2] for m, p in zip(blocks, paths) if p == path]
        own[path] = (sum(map(len, texts)), sum(map(len, texts)) / len(texts), sum(len(re.findall(r"[.,](?=\s|$)", t)) for t in texts) / len(texts))

    def prefix(start: str, i: int) -> float:
        below = [v for p, v in own.items() if (p + "/").startswith(start + "/")]
        return sum(v[0] * v[i] for v in below) / sum(v[0] for v in below)

    texts = [(p, own[p], len(m[2])) for m, p in zip(blocks, paths)]
    told = [v[1] * (1 + v[2]) * (4 if "article" in p else 0.5 if "footer" in p else 1) for p, v, _ in texts]
    rich = [(p, v, n) for (p, v, n), x in zip(texts, told) if x >= sum(told) / len(told) / 2 and "article" in p]
    area = [sum(n * v[i] for _, v, n in rich) / sum(n for _, _, n in rich) for i in (1, 2)]
    kept = []
    for m, path in zip(blocks, paths):
        steps, smooth = path.split("/"), []
        for i in (1, 2):
            total, weights, w = min(own[path][i], area[i - 1]), 1.0, 1.0
            for k in range(len(steps) - 1, 0, -1):
                start = "/".join(steps[:k])
                w *= how.step * (1 if start.endswith("article") or "/article/" in start else how.above) * (how.cut if steps[k] == "footer" else 1)
                total += w * min(area[i - 1] if start.endswith("article") else prefix(start, i), area[i - 1])
                weights += w
            smooth.append(total / weights)
        ratio = smooth[0] * (1 + smooth[1]) * (1 if "article" in steps else how.outside)
        if ratio >= how.threshold * area[0] * (1 + area[1]):
            kept.append(m[2].strip())
    return kept


def test_selection_against_a_table_of_paths():
    rng = random.Random(5)
    words = lambda n: " ".join(rng.choice(["word", "longer", "it.", "on,"]) for _ in range(n))
    for _ in range(60):
        middle = "".join(rng.choice(["<p>{}</p>", "<section><div><ul><li>{}</li></ul></div></section>", "<ul><li>{}</li></ul>", "<div><section><table><tr><td>{}</td></tr></table></section></div>"]).format(words(rng.choice([1, 2, 9, 60]))) for _ in range(rng.randint(1, 6)))
        page = f"<body><p>{words(rng.choice([3, 20, 90]))}</p><article><h1>{words(3)}</h1><p>{words(80)}</p>{middle}</article></body>"
        assert extract(page).split("\n") == _brute(page), page


@pytest.mark.parametrize(
    "page",
    ["<div>" * 50_000 + "x", '<a x="' * 30_000, "<b>" * 30_000 + "</i>" * 30_000 + "x", "<i><div>" + "<b>" * 30_000 + "</i>" * 30_000 + "x", "<ul><li>" * 20_000, "<!--" * 30_000, "<script>" * 30_000, "<a " + "/ " * 30_000, "<a" + " " * 60_000, "<a " + "=" * 60_000, "<" * 100_000, '<p class="' + "ad-" * 30_000 + '">x'],
)
def test_hostile_pages_take_linear_time(page):
    began = time.perf_counter()
    extract(page)
    assert time.perf_counter() - began < 5


def test_odd_tables(spark):
    rows = [(1, "u", f"<p>{L}"), (1, "u", f"<p>{L}"), (None, None, None), (2, "v", ""), (3, "w", "<p>" + "word. " * 200_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(7)).withColumn("n_chars", F.lit("clash"))
    out = html_extract.main_text(pages)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = sorted((tuple(r) for r in out.collect()), key=repr)
    assert [(i, u, n) for i, u, _, n in got] == [(1, "u", len(L)), (1, "u", len(L)), (2, "v", 0), (3, "w", 1_199_999), (None, None, 0)]
    assert html_extract.main_text(pages.limit(0)).count() == 0
