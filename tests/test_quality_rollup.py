"""The quality roll-up reads the cells of all workbooks for several of its checks."""

from surveyloom.queries import answer_ingest, charts

SF = "/root/testdata/sf0.001"


def test_cells_are_made_and_stored_once(spark, monkeypatch):
    made = []
    cells = answer_ingest.cells
    monkeypatch.setattr(answer_ingest, "cells", lambda *given: made.append(given) or cells(*given))
    rows = charts.quality_rollup(spark, SF).collect()
    assert len(made) == 1
    assert {"normalize", "titles", "rules", "charts", "questions"} == {r.stage for r in rows}
