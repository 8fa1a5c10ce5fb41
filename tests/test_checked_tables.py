"""Tables judged by their rules, and chains without a Python worker."""

from panelwerk.operators import chains as C
from panelwerk.sources import tables as TB


def test_rows_that_break_a_rule(spark, tmp_path):
    series = spark.createDataFrame([(1, "A", "it", "sr"), (2, "A", "it", "sr"), (None, "C", "it", "sr"), (None, "D", "it", None)], "series_id long, name string, source_lang string, target_lang string")
    albums = spark.createDataFrame([(10, 1), (10, 1), (11, 7), (12, None)], "album_id long, series_id long")
    ratings = spark.createDataFrame([(1, "s", 1, "x", None), (2, "s", 1, "x", 6), (3, None, 1, "x", 5)], "rating_id long, study string, item long, candidate string, score int")
    sheets = spark.createDataFrame([(100, 10, "original")], "page_id long, album_id long, kind string")  # without positions and sizes
    given = {"series": series, "albums": albums, "ratings": ratings, "sheets": sheets}
    sound, rejected = TB.checked_tables({n: TB.conform(df, n) for n, df in given.items()})
    found = sorted((r.table, r.key, tuple(r.reasons)) for r in rejected.collect())
    assert found == [
        ("albums", "10", ("repeated album_id",)),
        ("albums", "11", ("no series for series_id",)),
        ("albums", "12", ("series_id missing",)),
        ("ratings", "2", ("score 6",)),
        ("ratings", "3", ("study missing",)),
        ("series", "", ("series_id missing",)),
        ("series", "", ("series_id missing", "target_lang missing")),
        *[("series", k, ("repeated name",)) for k in {"1", "2"} - {str(r.series_id) for r in sound["series"].collect()}],
        ("sheets", "100", ("position missing", "import_order missing", "width missing", "height missing")),
    ]
    assert sound["albums"].count() == 1 and sound["ratings"].count() == 1 and sound["series"].count() == 1 and sound["sheets"].count() == 0
    assert sound["albums"].columns == [f.name for f in TB.schema("albums")]
    assert set(TB.RULES) <= set(TB.SCHEMAS) and all({*r.key, *r.given, *r.refers, *r.among} <= {f.name for f in TB.schema(n)} for n, r in TB.RULES.items())


def test_chains_stay_in_the_jvm(spark):
    rows = [(1, 10, 1, 11), (1, 11, 2, 12), (1, 12, 3, None), (1, 13, 4, 12), (1, 14, 5, 15), (1, 15, 6, 14), (1, 16, 7, 16), (1, 17, 8, 99), (1, 18, 9, 14), (2, 20, 1, None)]
    blocks = spark.createDataFrame(rows, "page_id long, block_id long, position long, continues_id long")
    chains = C.resolve_chains(blocks)
    plan = chains._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    found = {r.block_id: (r.head, r.part) for r in chains.collect()}
    assert found == {10: (10, 0), 11: (10, 1), 12: (10, 2), 13: (13, 0), 14: (18, 1), 15: (18, 2), 16: (16, 0), 17: (17, 0), 18: (18, 0), 20: (20, 0)}


def test_every_form_of_links_of_a_small_page(spark):
    """All ways in which four blocks can continue: parts count up along links, every block is in one chain, heads are followed by none or in rings."""
    rows = []
    for page in range(5**4):
        digits = [page // 5**k % 5 for k in range(4)]
        rows += [(page, 10 * page + k, k, None if d == 4 else 10 * page + d) for k, d in enumerate(digits)]
    blocks = spark.createDataFrame(rows, "page_id long, block_id long, position long, continues_id long")
    after = {b: c for _, b, _, c in rows}
    found = {r.block_id: (r.head, r.part) for r in C.resolve_chains(blocks).collect()}
    assert found.keys() == after.keys()
    followed = {c for c in after.values() if c is not None}
    for block, (head, part) in found.items():
        at = head
        for _ in range(part):
            at = after[at]
        assert at == block
        if head in followed:  # a ring that no chain leads into: its first block is the head
            ring, at = {head}, after[head]
            while at not in ring:
                ring.add(at)
                at = after[at]
            assert head == min(ring) and block in ring
        else:  # the earliest of all heads that lead here
            leading = []
            for h in (b for b in after if b // 10 == block // 10 and b not in followed):
                seen, at = [], h
                while at is not None and at not in seen:
                    seen.append(at)
                    at = after[at]
                if block in seen:
                    leading.append(h)
            assert head == min(leading)
