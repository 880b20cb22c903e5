"""Physical-plan properties the design relies on (see docs/PLANS.md)."""

import pytest

import __spark_entry__ as E

from conftest import SF_SMALL

BATCH = ["features_full", "lag_features", "rolling_means", "chrono_split", "scaled_features", "sequence_ends",
         "latest_complete", "latest_sequence", "alerts", "alert_rows", "conditions", "tomorrow_condition",
         "hourly_24h", "ten_day", "today_range", "context_series", "history_range", "hourly_from_daily",
         "model_metrics", "best_model", "last_120", "cached_payload"]


def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def broadcast_subtrees(text: str) -> list[str]:
    lines = text.splitlines()
    out = []
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            depth = len(line) - len(line.lstrip(" :+-"))
            sub = [line]
            for nxt in lines[i + 1:]:
                if len(nxt) - len(nxt.lstrip(" :+-")) <= depth:
                    break
                sub.append(nxt)
            out.append("\n".join(sub))
    return out


@pytest.mark.parametrize("name", BATCH)
def test_no_quadratic_joins_and_fact_never_broadcast(spark, name):
    text = plan_text(E.queries()[name](spark, SF_SMALL))
    assert "BroadcastNestedLoopJoin" not in text and "CartesianProduct" not in text
    assert all("lineitem" not in sub and "events" not in sub for sub in broadcast_subtrees(text))


@pytest.mark.parametrize("name", ["features_full", "chrono_split", "scaled_features", "sequence_ends",
                                  "model_metrics", "best_model", "last_120"])
def test_one_shuffle_for_the_daily_aggregate_and_one_for_all_windows(spark, name):
    text = plan_text(E.queries()[name](spark, SF_SMALL))
    assert text.count("Exchange hashpartitioning") == 2, text


def test_scan_reads_only_needed_columns(spark):
    text = E.queries()["features_full"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    scan = [ln for ln in text.splitlines() if "lineitem.parquet" in ln][0]
    assert "l_comment" not in scan and "l_orderkey" not in scan
