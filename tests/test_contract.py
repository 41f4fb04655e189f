"""Driver contract: entry(), queries(), oracle_sql()."""

import __spark_entry__ as E

ROWS_ONLY = {"STR-6", "TRN-1", "TRN-1-eval", "TRN-1-joint"}  # stateful timers / iterative fits


def test_oracles_match_queries():
    from seqwise.plans.oracle import all_oracles
    from seqwise.plans.registry import all_queries
    q, o = all_queries(), all_oracles()
    assert set(o) <= set(q)
    assert set(q) - set(o) == ROWS_ONLY
    assert set(q) <= set(E.queries()) and set(o) <= set(E.oracle_sql()) <= set(E.queries())


def test_every_survey_id_is_registered():
    ids = ([f"SRC-{i}" for i in range(1, 11)] + [f"DQ-{i}" for i in range(1, 8)]
           + [f"PRJ-{i}" for i in range(1, 6)] + [f"VOC-{i}" for i in range(1, 8)]
           + [f"JOI-{i}" for i in range(1, 6)] + [f"AGG-{i}" for i in range(1, 13)]
           + [f"WIN-{i}" for i in range(1, 8)] + [f"LBL-{i}" for i in range(1, 9)]
           + ["SEQ-1", "SEQ-2"] + [f"SRT-{i}" for i in range(1, 5)] + ["SMP-1", "SMP-2"]
           + [f"SET-{i}" for i in range(1, 4)] + [f"STO-{i}" for i in range(1, 5)]
           + [f"SCO-{i}" for i in range(1, 4)] + [f"MET-{i}" for i in range(1, 9)]
           + ["FBK-1", "FBK-2", "TRN-1"] + [f"STR-{i}" for i in range(1, 7)])
    assert set(ids) - set(E.queries()) == set()


def test_entry_is_the_flagship(spark):
    df = E.entry(spark)
    assert df.columns[:2] == ["muid", "event_id"] and "target_purchase" in df.columns
    assert df.count() == 700
