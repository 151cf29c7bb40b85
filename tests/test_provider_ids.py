"""One provider id in two fixtures quarantines both."""

import pandas as pd

from touchline.plans import ingest


def test_conflicts(spark, tmp_path):
    rows = [("{AB-1}", 7), ("ab1", 7), ("c", 7), ("d", 8), ("d", 8), ("e", None), (None, 9), ("f", 10), ("f", 11)]
    pd.DataFrame(rows, columns=["match_id", "provider_match_id"]).astype({"provider_match_id": "Int64"}).to_parquet(tmp_path / "open_matches.parquet")
    got = sorted(tuple(r) for r in ingest.provider_id_conflicts(spark, str(tmp_path)).collect())
    assert got == [("ab1", 7, 2, "QUARANTINED"), ("c", 7, 2, "QUARANTINED"), ("d", 8, 1, "UNIQUE"), ("f", 10, 1, "UNIQUE"), ("f", 11, 1, "UNIQUE")]
