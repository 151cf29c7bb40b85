"""Every query against its SQL twin; the others for a proof of their operator, rows, a stable schema and what must hold."""

from pathlib import Path

import pytest
from duck import connect, rows

from touchline.plans import context, forecasts, ingest, picks, problem_sql, problems, readiness, relational, results  # noqa: F401
from touchline.plans.registry import ORACLES, QUERIES

ALL = problems.queries() | QUERIES
SQL = problem_sql.oracle_sql() | ORACLES


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_its_sql(spark, sf, name):
    ours = ALL[name](spark, sf).toPandas()
    theirs = connect(sf).sql(SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


#: The queries without a twin, and the test that proves their operator another way: by brute force, a round trip, a library's result or held-out accuracy.
PROVED = {
    "corner_counts": "test_relations.test_seasons_and_corners", "dixon_coles_fit": "test_score_models", "elo_ratings": "test_engine.test_elo_against_a_plain_fold", "ensemble_weights": "test_engine.test_fits_recover_what_made_the_data",
    "exact_win_rates": "test_engine.test_exact_intervals", "form_report": "test_form.test_windows_against_plain_python", "forward_recalibration": "test_engine.test_fits_recover_what_made_the_data", "goal_regression": "test_engine.test_gates_leaks_and_regression",
    "loss_intervals": "test_bootstrap", "name_relations": "test_relations.test_names_against_plain_python", "p2_found": "test_timestamps", "p7_found": "test_shredding", "paired_loss_intervals": "test_bootstrap.test_paired_intervals",
    "payload_event_types": "test_event_shapes", "quality_findings": "test_quality_rules", "ratings_at_cutoff": "test_engine.test_ratings_of_a_table", "recalibration": "test_engine.test_fits_recover_what_made_the_data", "score_model_fits": "test_score_models", "simulated_events": "test_engine.test_simulation_gates",
    "simulation_checks": "test_engine.test_simulation_gates", "simulation_gates": "test_engine.test_simulation_gates", "stint_lengths": "test_engine.test_texts", "vector_scaling": "test_score_models.test_vector_scaling",
}
#: Whose result is empty on these tables: the payloads hold no corner.
EMPTY = {"corner_counts"}


def test_every_query_is_proved():
    assert set(ALL) - set(SQL) == set(PROVED)
    folder = Path(__file__).parent
    for proof in PROVED.values():
        file, _, name = proof.partition(".")
        assert f"def {name or 'test_'}" in (folder / f"{file}.py").read_text()


@pytest.mark.parametrize("name", sorted(PROVED))
def test_gives_rows_of_a_stable_schema(spark, sf, name):
    df = ALL[name](spark, sf)
    assert df.columns and df.schema == ALL[name](spark, sf).schema
    assert bool(df.take(1)) == (name not in EMPTY)


def test_numbers_that_must_hold(spark, sf):
    """What the results of queries without a twin must satisfy whatever the data are."""
    rates = ALL["exact_win_rates"](spark, sf)
    assert rates.where("not (low <= k / n and k / n <= high)").count() == 0
    assert abs(ALL["ensemble_weights"](spark, sf).agg({"weight": "sum"}).first()[0] - 1) < 1e-9
    curve = ALL["recalibration"](spark, sf).orderBy("class", "bin").collect()
    assert all(a["class"] != b["class"] or a.isotonic <= b.isotonic + 1e-12 for a, b in zip(curve, curve[1:]))
    events = ALL["simulated_events"](spark, sf)
    assert events.where("event like 'outcome:%' or event = 'unresolved_tail'").groupBy("forecast_id").sum("hits").where("`sum(hits)` <> 112460").count() == 0
    assert events.where("abs(hits / 112460 - analytic) > 0.02").count() == 0
    stints = ALL["stint_lengths"](spark, sf)
    assert stints.where("read > rows").count() == 0
    verdicts = {r.verdict for r in ALL["simulation_checks"](spark, sf).select("verdict").distinct().collect()}
    assert verdicts <= {"PASS", "WARN", "FAIL"}
