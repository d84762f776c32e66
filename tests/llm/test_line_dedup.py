from __future__ import annotations

from pagemill.llm.line_dedup import drop_lines
from pagemill.llm.queries import ORACLES
from tests.oracle import compare, connect


def brute(rows: list[tuple], ratio: float, least: int) -> list[tuple]:
    pages, total = {}, {}
    for _, host, text in rows:
        total[host] = total.get(host, 0) + 1
        for line in {x.strip(" ") for x in (text or "").split("\n")} - {""}:
            pages[host, line] = pages.get((host, line), 0) + 1
    drop = {(h, x) for (h, x), n in pages.items() if n >= least and n > ratio * total[h]}
    return [
        (i, h, None if t is None else "\n".join(x for x in t.split("\n") if (h, x.strip(" ")) not in drop))
        for i, h, t in rows
    ]


def test_against_a_fold(spark):
    rows = [(i, ["a", "b", None][i % 3], f"menu \nown {i}\n\n  menu\nhalf" if i % 2 else f"own {i}\nmenu") for i in range(60)]
    rows += [(100, "a", None), (None, "a", "menu"), (101, "c", "menu\nx"), (101, "c", "menu\nx"), (102, "b", ""), (103, "b", "long " * 9000 + "\nmenu")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, source string, text string, line int, pages int")
    out = drop_lines(docs)
    assert out.columns == docs.columns
    key = lambda r: (r[0] is None, r[0] or 0, str(r[1]), str(r[2]))
    assert sorted([tuple(r)[:3] for r in out.collect()], key=key) == sorted(brute(rows, 0.1, 5), key=key)
    assert drop_lines(docs.limit(0)).count() == 0


def test_query_against_sql(spark):
    from pagemill.llm.queries import QUERIES

    sf_dir = "/root/testdata/sf0.001"
    assert compare(QUERIES["op5_line_dedup"](spark, sf_dir), ORACLES["op5_line_dedup"], connect(sf_dir)) is None
