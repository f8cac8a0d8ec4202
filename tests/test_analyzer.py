import pytest

from tests.events import ev, rows
from tests.test_transactions import frame
from tidelog.operators.transactions import TransactionBoundaryError
from tidelog.options import AnalysisOptions
from tidelog.plans.analyze import analyze_rows
from tidelog.plans.analyzer import Analyzer
from tidelog.reports.render import render_json

EVENTS = [ev("BEGIN", 0), rows(5, 1, txn="t1"), ev("XID", 2), rows(3, 61, "shop.users", txn="t2"), ev("COMMIT", 62)]


def test_piece_by_piece_is_as_all_at_once(spark):
    want = render_json(analyze_rows(spark, EVENTS))
    one = Analyzer(spark)
    one.consume_all(EVENTS)
    assert render_json(one.finalize()) == want
    mixed = Analyzer(spark)
    mixed.consume(EVENTS[0])
    mixed.consume_frame(frame(spark, EVENTS[1:3]))
    mixed.consume_frame(frame(spark, EVENTS[3:4]))
    mixed.consume(EVENTS[4])
    assert render_json(mixed.finalize()) == want


def test_after_the_end(spark):
    one = Analyzer(spark, AnalysisOptions.unlimited())
    first = one.finalize()
    assert one.finalize() is first and first.summary.first()["total_events"] == 0
    with pytest.raises(ValueError, match="analyzer already finalized"):
        one.consume(EVENTS[0])


def test_failure_stays(spark):
    one = Analyzer(spark)
    one.consume_all([ev("BEGIN", 0), ev("BEGIN", 1), ev("XID", 2)])
    for _ in range(2):
        with pytest.raises(TransactionBoundaryError):
            one.finalize()
    with pytest.raises(TransactionBoundaryError):
        one.consume(EVENTS[0])
