"""Generated policy expressions: the compiled Column condition agrees with
Python's own evaluation of the same expression (null and mixed-type rules)."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from clientlens.operators import policy

STR_LITS = ["'high'", "'medium'", "'low'", "null", "true", "false"]
NAMES = ["churn_risk", "usage_level", "ca_total_high", "recent_one_shot"]

cmp = st.one_of(
    st.builds(lambda n, op, v: f"{n} {op} {v}", st.sampled_from(NAMES), st.sampled_from(["==", "!="]),
              st.sampled_from(STR_LITS)),
    st.builds(lambda n, op, vs: f"{n} {op} [{', '.join(vs)}]", st.sampled_from(NAMES), st.sampled_from(["in", "not in"]),
              st.lists(st.sampled_from(STR_LITS), min_size=1, max_size=3)),
    st.builds(lambda a, b: f"{a} == {b}", st.sampled_from(NAMES), st.sampled_from(NAMES)),
)
expr = st.recursive(cmp, lambda e: st.builds(lambda a, op, b: f"({a}) {op} ({b})", e, st.sampled_from(["and", "or"]), e),
                    max_leaves=4)

ROWS = [(r, u, c, o) for r in ("high", "medium", "low", None) for u in ("high", "low", None)
        for c in (True, False, None) for o in (True, None)]


def py_eval(e, row):
    ctx = {"__builtins__": {}, "true": True, "false": False, "null": None, **dict(zip(NAMES, row))}
    return bool(eval(e, ctx, {}))  # noqa: S307 - test oracle on generated, whitelisted grammar


@settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(expr, min_size=4, max_size=4))
def test_compiled_rules_match_python(spark, exprs):
    df = spark.createDataFrame(ROWS, "churn_risk string, usage_level string, ca_total_high boolean, recent_one_shot boolean")
    cols = [policy.compile_rule(e).alias(f"r{i}") for i, e in enumerate(exprs)]
    got = [tuple(r) for r in df.select(*cols).collect()]
    exp = [tuple(py_eval(e, row) for e in exprs) for row in ROWS]
    assert got == exp, [(e) for e in exprs]
