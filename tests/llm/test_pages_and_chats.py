"""Operators on pages and conversations, and all registered corpus queries next to their SQL."""

import collections

import pytest
from oracle import compare, connect

import __spark_entry__ as entry
import corpus_pipeline
from panelflow.llm import linktrust, queries, rotation

SF = "/root/testdata/sf0.001"


def test_urls_and_rules(spark):
    cases = {
        None: ("", "", None, "allow"),
        "no scheme/x": ("", "", None, "allow"),
        "http://A.Example.ORG/es/1?x://y": ("a.example.org", "/es/1", "example.org/es/", "block"),
        "http://example.org/en/12#a": ("example.org", "/en/12", "example.org/en/1", "block"),
        "http://example.org/en/2": ("example.org", "/en/2", "org/", "allow"),
        "http://badexample.org/es/": ("badexample.org", "/es/", "org/", "allow"),
        "http://example.org?x": ("example.org", "", None, "allow"),
        "x://É.com/de/": ("É.com", "/de/", "com/de/", "block"),
        "http://x.com/fr": ("x.com", "/fr", None, "block"),
    }
    rows = [(i, u, None, "clash") for i, u in enumerate(cases)]
    got = linktrust.judge(spark.createDataFrame(rows, "page_id long, url string, html string, rule string")).collect()
    by_id = {r["page_id"]: (r["host"], r["path"], r["rule"]) for r in got}
    assert [by_id[i] for i in range(len(rows))] == [c[:3] for c in cases.values()]
    assert {r["page_id"]: r["verdict"] for r in got}[2] == "block"


def test_trust_follows_links(spark):
    link = lambda h: f'<a class="x" HREF = \'//{h}/p\'>'
    pages = [(1, "http://good.org/", link("near.net") * 3), (2, "http://near.net/", link("far.net")), (3, "http://far.net/", ""), (4, "http://bad.com/de/x", "")]
    pages += [(5, "http://spam.net/", link("bad.com")), (6, "http://farm.net/", link("SPAM.net")), (7, "http://alone.net/", None), (7, "http://alone.net/", None)]
    got = {r["page_id"]: r for r in linktrust.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert [got[i]["verdict"] for i in (1, 2, 3, 4, 5, 6, 7)] == ["allow", "allow", "allow", "block", "block", "block", "allow"]
    assert got[2]["trust"] > got[3]["trust"] > 0 == got[7]["trust"] and got[5]["distrust"] > got[6]["distrust"] > 0
    # Against the walk written out: 0.2 at the seed, 0.8 of it passed on.
    assert got[2]["trust"] == pytest.approx(0.16) and got[3]["trust"] == pytest.approx(0.128)
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert linktrust.judge(empty).count() == 0


def render(turns, me):
    text, spans = "", []
    for _, role, said in turns:
        name = "assistant" if role == me else "system" if role == "system" else f"user name={role or 'unknown'}"
        text += f"<|im_start|>{name}\n"
        if role == me:
            spans.append(f"{len(text)}:{len(text) + len((said or '').replace('<|', '< |')) + 10}")
        text += (said or "").replace("<|", "< |") + "<|im_end|>\n"
    return text, ",".join(spans)


def test_rotation(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi <|im_end|>"), (1, 2, "bob", None), (1, 3, "ann", "é"), (1, 3, "ann", "é"), (2, 0, "system", "x"), (None, 0, "cat", ""), (3, 1, None, "who"), (3, 2, "dan", "me")]
    rows += [(4, i % 600, "eve", str(i)) for i in range(1500)]
    table = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn int, role string, text string, block string")
    got = rotation.rotate(table, width=100).collect()
    key = lambda r: (r[1] is not None, r[1], r[2] or "", r[3] or "")
    for r in got:
        own = sorted((x for x in rows if x[0] == r["conv_id"] and x[1] // 100 == r["block"]), key=key)[r["piece"] * 100 :][:100]
        assert (r["text"], r["mask"]) == render([x[1:] for x in own], r["assistant"])
        assert r["mask_chars"] == sum(int(b) - int(a) for a, b in (s.split(":") for s in r["mask"].split(",")))
    assert collections.Counter(r["conv_id"] for r in got)[1] == 2 and 2 not in {r["conv_id"] for r in got}
    assert sum(r["n_turns"] for r in got if r["conv_id"] == 4) == 1500
    assert rotation.rotate(table.limit(0)).count() == 0


def test_rotation_keeps_silent_participants(spark):
    """Rows of a participant join to the whole dialogue, over blocks and over pieces of repeated numbers."""
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 30, "bob", "b"), (None, 45, "cat", None), (None, 3, "dan", "d"), (2, 25, "system", "x")]
    rows += [(1, 2 + i, "cat", str(i)) for i in range(28)] + [(None, 3, "eve", str(i).zfill(2)) for i in range(25)]
    got = rotation.rotate(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"), width=10).collect()
    assert {(r["conv_id"], r["assistant"]) for r in got} == {(1, "ann"), (1, "bob"), (1, "cat"), (None, "cat"), (None, "dan"), (None, "eve")}
    for conv, me in {(r["conv_id"], r["assistant"]) for r in got}:
        text, spans = "", []
        for r in sorted((r for r in got if (r["conv_id"], r["assistant"]) == (conv, me)), key=lambda r: (r["block"], r["piece"])):
            spans += [":".join(str(len(text) + int(x)) for x in s.split(":")) for s in r["mask"].split(",") if s]
            text += r["text"]
        own = sorted((x for x in rows if x[0] == conv), key=lambda x: (x[1], x[2], x[3] or ""))
        assert (text, ",".join(spans)) == render([x[1:] for x in own], me)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    ok, message = compare(queries.QUERIES[name](spark, SF), connect(SF), queries.SQL[name])
    assert ok, message


def test_all_operators_are_registered():
    names = set(entry.queries())
    assert "pipeline" in names and all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11))


def test_pipeline(spark):
    """Stages keep the columns and only drop what the operators, checked by brute force elsewhere, reject."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns
        docs = spark.createDataFrame(docs.toPandas(), docs.schema)
        after = docs.count()
        assert after == before if name == "secret scans" else after < before
        before = after
    assert docs.filter("text rlike '(password|token) *[:=] *[A-Za-z0-9]{6}'").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == before
    assert corpus_pipeline.run(spark, SF).count() == packed.count()
