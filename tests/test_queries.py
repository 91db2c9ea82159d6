"""Every registered query against its DuckDB SQL on the smallest tables."""

import math

import duckdb
import pandas as pd
import pytest

from chronoweave.plans import registry
from tests.conftest import SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return c


def plain(df):
    df = df[sorted(df.columns)]
    show = lambda x: "null" if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and math.isnan(x)) else repr(float(x)) if isinstance(x, float) else str(x)
    return sorted(tuple(map(show, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", registry.QUERIES)
def test_query(spark, con, name):
    got = registry.QUERIES[name](spark, SMALL).toPandas()
    if name in registry.ORACLES:
        want = con.sql(registry.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert plain(got) == plain(want)
    else:
        assert len(got)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_token_edits_by_brute_force(spark, con):
    """Coverage of every turn against the one before it, and that no polarity word vanishes or appears in silence."""
    import difflib
    import re

    from chronoweave.operators import textops

    names = {r[0]: r for r in con.sql("select conv_id || '-' || turn, lag(text) over (partition by conv_id order by turn), text from conversations").fetchall()}
    rare = set(textops.POLARITY) | set(textops.QUANTITY) | set(textops.MODALITY) | set(textops.ACTOR)

    def words(text):
        out = [textops.NUMBERS.get(w, w) for w in (re.sub("[^a-z0-9']", "", x.lower()) for x in text.split()) if w]
        assert not any("'" in w or w in textops.NO_APOSTROPHE for w in out)  # nothing to write out in these texts
        return out

    seen = 0
    for r in registry.QUERIES["token_edits"](spark, SMALL).collect():
        _, before, now = names[f"{r['conv_id']}-{r['turn']}"]
        said, heard = words(before), words(now)
        open_ = sorted({w for w in said if len(w) >= 4 and w not in rare and not re.fullmatch(r"\d+(st|nd|rd|th)?", w)})
        for i, w in enumerate(heard):
            if w not in said and len(w) >= 4 and w not in rare and not re.fullmatch(r"\d+(st|nd|rd|th)?", w):
                best = max(((difflib.SequenceMatcher(None, v, w).ratio(), v) for v in open_), default=(0, ""))
                heard[i] = best[1] if best[0] >= 0.8 else w
        matched = sum(b.size for b in difflib.SequenceMatcher(None, said, heard, False).get_matching_blocks())
        coverage = matched / len(said) if said else 1.0
        assert (r["matched"], r["expected"]) == (matched, len(said)) and r["coverage"] == pytest.approx(coverage, abs=0.0051)
        assert r["flag"] or coverage >= 0.8
        assert not set(said) & set(textops.POLARITY) - set(heard) or r["risks"] > 0
        assert not r["risks"] or r["flag"] and r["reasons"]
        seen += 1
    assert seen > 30
