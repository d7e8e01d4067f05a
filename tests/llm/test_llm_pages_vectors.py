"""Page extraction and the embedding forest against brute force, with odd rows."""

import random

import numpy as np
import pytest

from maskweave.llm import forest, pages

HEAD = "<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a='</p>';</script></head><body>"


def test_lines_by_markup():
    page = HEAD + (
        "<header>Site</header><nav><ul><li><a>Home</a></li></ul></nav><div class='ad box'>Buy</div><form>Mail</form>"
        "<article><h1>Title &amp; more</h1><p><b>One\n two<br>three<p>Four</p><aside>Side</aside><div id=comments><p>Nice</p></div></article>"
        "<div class=cookie-notice>We</div><footer>&copy; x</footer>"
    )
    own = [t for _, z, t in pages.lines_of(page) if z != "chrome"]
    assert own == ["Title & more", "One two three", "Four"]
    assert pages.lines_of(None) == pages.lines_of("") == pages.lines_of("<p></p><!-- x") == []


def test_common_is_longest():
    rng = random.Random(1)

    def longest(a, b):
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        return best[-1][-1]

    for _ in range(300):
        a, b = ([rng.choice("abcde") for _ in range(rng.randrange(12))] for _ in range(2))
        left, right = pages.common(a, b)
        assert len(left) == len(right) == longest(a, b)
        assert [a[k] for k in sorted(left)] == [b[k] for k in sorted(right)]


def test_extract(spark):
    page = lambda body: f"{HEAD}<div>Shared menu</div>{body}<div>Shared end</div></body></html>"
    rows = [
        (1, "http://a.example/x/1", page("<div>First text.</div>")),
        (2, "http://a.example/x/2?q=1", page("<div>Second text.</div><div>More.</div>")),
        (3, "http://a.example/x/3#top", page("<div>Third text.</div>")),
        (4, "http://b.example/only", page("<div>Alone.</div>")),
        (5, None, None), (6, None, ""), (7, "not a url", "<p>plain"),
        (8, "http://c.example/1", "<article><p>Quoted by both.</p><p>A</p></article>"),
        (9, "http://c.example/2", "<article><p>Quoted by both.</p><p>B</p></article>"),
        (10, "http://d.example/1", page("<p>Copy</p>")), (11, "http://d.example/2", page("<p>Copy</p>")),
        (4, "http://b.example/only", page("<div>Alone.</div>")),
    ]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "page_id bigint, url string, html string, text string").repartition(3)
    got = sorted((r.page_id, r.text) for r in pages.extract(docs).collect())
    alone, copy = "Shared menu\n\nAlone.\n\nShared end", "Shared menu\n\nCopy\n\nShared end"
    assert got == [
        (1, "First text."), (2, "Second text.\n\nMore."), (3, "Third text."), (4, alone), (4, alone), (5, ""), (6, ""), (7, "plain"),
        (8, "Quoted by both.\n\nA"), (9, "Quoted by both.\n\nB"), (10, copy), (11, copy),
    ]
    assert pages.extract(docs.limit(0)).count() == 0


@pytest.mark.parametrize("block", [1024, 20])
def test_forest_recall(spark, block):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((60, 24))
    rows = []
    for k in range(900):
        v = centres[k % 60] + rng.standard_normal(24) * rng.choice([0.05, 0.3, 1.0])
        rows.append((k, [float(x) for x in v], k % 3 if k % 7 else None))
    rows += [(1000 + k, rows[1][1], 1) for k in range(30)]
    rows += [(2000, None, 1), (2001, [0.0] * 24, 1), (2002, [float("nan")] + [1.0] * 23, 1), (2003, [None] + [1.0] * 23, 1)]
    rows += [(2004, [float("inf")] + [1.0] * 23, 1), (2005, [], 1), (2006, [1e300, 1e300], 1), (2007, [1.0, 1.0], 1), (None, [3.0, 3.0], 1)]
    rows += [(1, rows[1][1], 1)]
    docs = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").repartition(3)
    got = forest.near_duplicates(docs, forest.ForestRules(leaf=40, block=block)).collect()
    assert len(got) == len(rows)
    want = found = 0
    by_id = {r.vec_id: r for r in got}
    good = [(i, np.array(v, float), c) for i, v, c in rows if i is not None and i < 1900 and c is not None]
    unit = np.array([v / np.linalg.norm(v) for _, v, _ in good])
    label = np.array([c for *_, c in good])
    linked = (unit @ unit.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(linked, False)
    for k, (i, _, _) in enumerate(good):
        assert by_id[i].n_links <= linked[k].sum()
        want, found = want + linked[k].sum(), found + by_id[i].n_links
    assert found >= 0.9 * want
    assert by_id[1].n_links >= 31 and by_id[1000].component_id == by_id[1].component_id
    for k in (2000, 2001, 2002, 2003, 2004, 2005):
        assert (by_id[k].n_links, by_id[k].component_id, by_id[k].kept) == (0, k, True)
    assert by_id[2006].n_links == 2 and by_id[2007].component_id == 2006 and by_id[None].component_id == 2006
    assert forest.near_duplicates(docs.limit(0)).count() == 0
