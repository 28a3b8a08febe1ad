from collections import Counter

from pyspark.sql import functions as F

from iolens.llm import site_lines as S


def test_html_lines(spark):
    pages = [
        (0, None), (1, ""), (2, "plain"), (3, "<p>a  b\n c</p><p><b>d</b>e<br>f<script>x<p>y</script><!-- z <p> -->g</p>"),
        (4, "<style>p{}</style><UL><LI>One<LI class='x'>Two &amp;</UL>"), (5, "1 < 2 <em>ok</em>"),
    ]
    df = spark.createDataFrame(pages, "page_id long, html string").select("page_id", S.html_lines(F.col("html")).alias("lines"))
    assert {r.page_id: r.lines for r in df.collect()} == {
        0: [], 1: [], 2: ["plain"], 3: ["a b c", "de", "f g"], 4: ["One", "Two &amp;"], 5: ["1 < 2 ok"],
    }


def test_host_of(spark):
    urls = {
        "HTTP://User@Www.Example.com:80/x?y#z": "www.example.com", "https://a.b": "a.b", "https://a.b#top": "a.b",
        "no url": None, "": None, None: None, "//x/y": None, "https://h?q=1": "h",
    }
    df = spark.createDataFrame([(u,) for u in urls], "url string").select("url", S.host_of(F.col("url")).alias("host"))
    assert {r.url: r.host for r in df.collect()} == urls


def test_against_brute_force(spark):
    rows = []
    for i in range(300):
        host = None if i % 10 == 9 else f"h{i % 7 % 3}" if i > 4 else "small"
        lines = None if i % 50 == 0 else [f"own {i}", "", "footer"] + ["menu"] * (i % 2) + ["menu"] + ["rare"] * (i % 3 == 0)
        rows.append((i, host, lines, "x"))
    rows += [(7, "h1", ["footer", "footer"], "x")] * 2
    pages = spark.createDataFrame(rows, "page_id long, host string, lines array<string>, line string")
    got = S.drop_site_lines(pages, "host", "lines")
    assert got.columns == ["page_id", "host", "lines", "line", "n_dropped"]
    total, count = Counter(), Counter()
    for _, host, lines, _ in rows:
        if host:
            total[host] += 1
            count.update((host, s) for s in set(lines or ()))

    def drop(host, s):
        over = count[host, s] - S.RATIO * total[host]
        return host is not None and over > 0 and over**2 > S.CERTAINTY**2 * S.RATIO * (1 - S.RATIO) * total[host]

    want = []
    for page, host, lines, _ in rows:
        kept = [s for s in lines or [] if not drop(host, s)]
        want.append((page, host, kept, len(lines or []) - len(kept)))
    assert sorted(((r.page_id, r.host, r.lines, r.n_dropped) for r in got.collect()), key=str) == sorted(want, key=str)
    assert sum(n for *_, n in want) > 200
    assert S.drop_site_lines(pages.limit(0), "host", "lines").collect() == []
