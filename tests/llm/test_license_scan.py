import textwrap

import duckdb
import pytest
from pyspark.sql import functions as F

from ridgeline.llm import license_scan as op
from ridgeline.llm.license_long_texts import LONG
from ridgeline.llm.license_texts import KNOWN


@pytest.fixture(scope="module")
def known(spark):
    return op.known_licenses(spark)


def canonical(spark, texts):
    """The canonical form of each text, in order."""
    df = spark.createDataFrame(list(enumerate(texts)), "n int, text string").repartition(4)
    return [r["f"] for r in op.forms(df, "text", "f", "w", "l").orderBy("n").collect()]


def test_equivalent_texts_have_one_digest(spark):
    mit = KNOWN["MIT"]
    same = [
        mit, mit.upper(), mit.replace("\n", " \r\n\t"), "Copyright (c) 2020 Somebody\n" + mit, "# Copyright 1999, 2001 A. N. Other <a@b.c>\n\n(c) 2011\n© X\nAll rights reserved.\n" + mit,
        mit.replace('"', "“"), mit.replace("sublicense", "sub-license"), mit.replace("COPYRIGHT HOLDERS", "COPYRIGHT OWNERS"), mit.replace(",", " ,").replace(".", ""),
    ]
    assert len(set(canonical(spark, same))) == 1
    more, a, b, *empty, stays = canonical(spark, [mit + " and more", "The licence of the organisation", "the LICENSE of the organization!", None, " ...\n", "Copyright 2020 X", "copyrighted works stay"])
    assert more != canonical(spark, [mit])[0] and a == b and empty == ["", "", ""] and stays == "copyrighted works stay"


def test_known_texts_differ(spark):
    assert len(set(canonical(spark, list(KNOWN.values())))) == len(KNOWN)


ROWS = [(1, KNOWN["ISC"].lower()), (2, "Copyright 2020 me\n" + KNOWN["BSD-3-Clause"]), (3, "text " * 50_000), (4, None), (5, ""), (6, "Some text.\nReleased under the MIT license\nmore"), (1, KNOWN["ISC"]), (None, KNOWN["Zlib"])]


def test_scan(spark, known):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").withColumns({"license_id": F.lit("mine"), "digest": F.lit(1), "known_digest": F.lit(2), "scan_low": F.lit(3)})
    out = op.scan(docs, known)
    assert sorted(((r["doc_id"], r["license_id"]) for r in out.collect()), key=repr) == sorted([(1, "ISC"), (2, "BSD-3-Clause"), (3, None), (4, None), (5, None), (6, None), (1, "ISC"), (None, "Zlib")], key=repr)
    assert out.where("doc_id IN (4, 5)").where("license_digest IS NOT NULL").count() == 0
    assert {(r["doc_id"], r["license_id"]) for r in op.scan_lines(docs, known).collect()} == {(6, "MIT-line")}
    assert op.scan(docs.limit(0), known).count() == 0


def test_lines_go_by_row(spark, known):
    rows = [(None, "Released under the MIT license"), (None, "nothing here"), (7, "a\nLicensed under CC BY 4.0\nReleased under the MIT license"), (7, "none"), (7, "a\nLicensed under CC BY 4.0\nReleased under the MIT license"), (8, None), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lines": F.lit(1), "whole": F.lit(2), "identity": F.lit(3)})
    out = [(r["doc_id"], r["line_licenses"]) for r in op.scan_all(docs, known).collect()]
    assert sorted(out, key=repr) == sorted([(None, "MIT-line"), (None, None), (7, "CC-BY-4.0-line,MIT-line"), (7, None), (7, "CC-BY-4.0-line,MIT-line"), (8, None), (None, None)], key=repr)
    assert op.scan_all(docs.limit(0), known).count() == 0
    assert {(r["doc_id"], r["license_id"]) for r in op.scan_lines(docs, known).collect()} == {(None, "MIT-line"), (7, "MIT-line"), (7, "CC-BY-4.0-line")}


def test_planted_licences_against_sql(spark, tmp_path):
    """A documents table with whole licences, copies of them in other dress, and near misses: query and SQL agree."""
    rows, n = [], 0
    for k, v in [*KNOWN.items(), *LONG.items()]:
        for t in (v, textwrap.fill(" ".join(v.split()), 66), "Copyright (c) 2021 The Authors\n" + v, v + " more"):
            rows.append((n, t))
            n += 1
    rows += [(n, "Text of a page.\nLicensed under the Apache License, Version 2.0.\nEnd."), (n + 1, None), (n + 2, ""), (n + 3, "© 2020 X"), (n + 4, "plain text\r\nReleased under the MIT license\r\nThis work is licensed under CC BY 4.0")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = op.query(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(op.SQL)
    assert sorted(got.columns) == sorted(want.columns)
    order = ("doc_id", "license_digest", "license_id", "line_licenses")
    found = sorted(map(tuple, got.select(*order).collect()), key=repr)
    assert found == sorted(want.project(", ".join(order)).fetchall(), key=repr)
    ids = {i: x for i, _, x, _ in found}
    for j, k in enumerate([*KNOWN, *LONG]):
        assert ids[4 * j] == ids[4 * j + 1] == ids[4 * j + 2] == k and ids[4 * j + 3] is None
    assert sum(x is not None for *_, x in found) >= 2


def test_ids_with_one_digest(spark):
    known = op.known_licenses(spark, {"b": "Some Licence", "a": "some license!"})
    assert [r["license_id"] for r in op.scan(spark.createDataFrame([(1, "SOME LICENSE")], "doc_id long, text string"), known).collect()] == ["a"]


def test_wrapping_does_not_matter(spark):
    texts, wants = [], []
    for name in sorted(KNOWN):
        for words in (KNOWN[name], KNOWN[name].upper()):
            for width in [*range(20, 131, 3), 75, 76, 1_000_000]:
                wrapped = textwrap.fill(" ".join(words.split()), width, break_long_words=False, break_on_hyphens=False)
                texts += [wrapped, "Copyright (c) 2020 A. Holder\n\n" + wrapped]
                wants += [name, name]
    forms = dict(zip(sorted(KNOWN), canonical(spark, [KNOWN[k] for k in sorted(KNOWN)])))
    assert canonical(spark, texts) == [forms[k] for k in wants]
    assert "liable for any claim" in forms["MIT"]


def test_only_notices_are_removed(spark):
    gone = [
        "Copyright 2020 X", "copyright (C) X", "Copyright: © 2020", "Copyright by X", "Copyright [yyyy] [name of copyright owner]", "Copyright (c) <year> <owner>", "(c) 2011 X", "(C) Copyright X", "© X",
        " * Copyright X. All rights reserved.", "All rights reserved.", "All Rights Reserved, (c) X", "# All rights reserved by X",
    ]
    assert canonical(spark, [f"a\n{x}\nb" for x in gone]) == ["a b"] * len(gone)
    stay = [
        "copyright holders be liable", "copyright notice and this permission notice", "(c) You must retain all notices", "copyright. All other terms", "Copyright bylaws", "copyright 20 times", "copyright 20201 x",
        "all rights reserved to the states", "Copyright 2020 X. " + "body text " * 50,
    ]
    assert all(len(x.split()) >= 4 for x in canonical(spark, [f"a\n{x}\nb" for x in stay]))


def test_long_licences_and_notices(spark, known):
    lines = {
        "This work is licensed under the GNU General Public License, version 2.": "GPL-2.0-line", "Licensed under CC BY 4.0": "CC-BY-4.0-line", "Released under the BSD 3-Clause License": "BSD-3-Clause-line",
        "This project is licensed under the Mozilla Public License 2.0.": "MPL-2.0-line", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0-line",
    }
    found = op.scan_lines(spark.createDataFrame([(k, f"a\n{k}\nb") for k in lines], "doc_id string, text string"), known).collect()
    assert {r["doc_id"]: r["license_id"] for r in found} == lines and len(found) == len(lines)


def test_no_python_on_the_way(spark, known):
    plan = op.scan(spark.createDataFrame([(1, "a")], "doc_id long, text string"), known)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
