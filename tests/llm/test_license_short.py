import os

import duckdb
import pytest

from trailmill.llm import license_scan as L
from trailmill.llm.registry import QUERIES

LINES = ["All rights reserved.", "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", "Released under the MIT License."]
NAMES = ["Proprietary", "Apache-2.0", "GPL-3.0", "CC-BY-NC-4.0", "MIT"]
FOLDER = "/root/testdata/sf0.001"


def test_every_licence_line_of_the_documents_is_found(spark):
    texts = [f"Some prose before it.\n{x}\nand after" for x in LINES] + LINES + ["all rights", None, "All rights reserved. " + L.TEMPLATES["Proprietary"][1]]
    out = {(r.doc_id, r.license): r for r in L.matches(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert {k for k in out if k[0] < 10} >= {(i, NAMES[i % 5]) for i in range(10)}
    assert not {k for k in out if k[0] in (10, 11)}
    assert out[0, "Proprietary"].first_token == 4 and out[0, "Proprietary"].n_windows == 1 and out[5, "Proprietary"].containment == 10000
    assert [k for k in out if k[0] == 12] == [(12, "Proprietary")]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
def test_matches_its_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    names = "doc_id, license, first_token, n_windows, containment"
    got = sorted(tuple(r) for r in QUERIES["op7_license_scans"](spark, FOLDER).selectExpr(*names.split(", ")).collect())
    assert got == sorted(con.sql(f"SELECT {names} FROM ({L.ORACLE_SQL})").fetchall())
