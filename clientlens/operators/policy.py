"""Next-best-action policy: rule features, churn risk buckets, rules compiled
to Column conditions, and the decision record.

A policy rule is compiled once on the driver into a boolean Column; all rules
become a single ``coalesce(when(c1, r1), when(c2, r2), ...)`` projection, so
deciding for every client is one narrow stage (no shuffle, codegen'd)."""

from __future__ import annotations

import ast
from dataclasses import dataclass, field
from importlib import resources
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

@dataclass(frozen=True)
class Rule:
    name: str
    expr: str
    priority: int
    action: str
    rationale: str
    rule_index: int = 0


@dataclass(frozen=True)
class Policy:
    version: int
    rules: list[Rule]
    thresholds: dict = field(default_factory=dict)


#: Where a rule's fields stand in the file, and how they are read.
_RULE_FIELDS = {"name": ("name", str), "expr": ("if", str), "priority": ("priority", int), "action": ("action", str)}


class PolicyError(ValueError):
    pass


def _rule(place: int, entry: dict) -> Rule:
    missing = [key for key, _ in _RULE_FIELDS.values() if key not in entry]
    if missing:
        raise PolicyError(f"rule {place}: no {', '.join(missing)}")
    try:
        known = {name: read(entry[key]) for name, (key, read) in _RULE_FIELDS.items()}
    except (TypeError, ValueError) as e:
        raise PolicyError(f"rule {place}: {e}") from e
    return Rule(**known, rationale=str(entry.get("rationale", "")), rule_index=place)


def _policy_from_dict(data: dict) -> Policy:
    body = (data or {}).get("policy") or {}
    entries = body.get("prioritization") or []
    rules = [_rule(i, x if isinstance(x, dict) else {}) for i, x in enumerate(entries)]
    return Policy(int((data or {}).get("version", 1)), sorted(rules, key=lambda r: (r.priority, r.rule_index)), body.get("thresholds") or {})


def load_policy(path: str | None = None) -> Policy:
    """Read a YAML policy (default: the packaged one)."""
    import yaml

    if path is None:
        text = resources.files("clientlens.config").joinpath("policy.yaml").read_text(encoding="utf-8")
    else:
        with open(path, encoding="utf-8") as f:
            text = f.read()
    return _policy_from_dict(yaml.safe_load(text))


def rules_table(spark: SparkSession, policy: Policy) -> DataFrame:
    schema = "rule_index int, name string, expr string, priority int, action string, rationale string"
    rows = [(r.rule_index, r.name, r.expr, r.priority, r.action, r.rationale) for r in policy.rules]
    return spark.createDataFrame(rows, schema).orderBy("priority", "rule_index")


# fixed values: (group, key) -> default, least and greatest value allowed
THRESHOLDS = {
    ("churn_risk", "low_max"): (0.20, 0.0, 1.0),
    ("churn_risk", "medium_max"): (0.50, 0.0, 1.0),
    ("usage_level", "high_sessions"): (30, float("-inf"), float("inf")),
    ("usage_level", "low_sessions"): (8, float("-inf"), float("inf")),
}


def _threshold(policy: Policy | None, group: str, key: str):
    """(value, was it readable): the default's type and bounds decide."""
    default, least, most = THRESHOLDS[group, key]
    given = ((policy.thresholds if policy else None) or {}).get(group) or {}
    if key not in given:
        return default, True
    try:
        value = type(default)(given[key])
    except (TypeError, ValueError):
        return default, False
    return (value if least <= value <= most else default), True


def churn_thresholds(policy: Policy | None) -> tuple[float, float]:
    """(low_max, medium_max); a value out of bounds is its default, an unreadable one or
    an order that makes no sense gives both defaults."""
    names = [("churn_risk", "low_max"), ("churn_risk", "medium_max")]
    found = [_threshold(policy, *n) for n in names]
    (low, _), (medium, _) = found
    if all(ok for _, ok in found) and low < medium:
        return low, medium
    return tuple(THRESHOLDS[n][0] for n in names)


def usage_thresholds(policy: Policy | None) -> tuple[int, int]:
    return tuple(_threshold(policy, "usage_level", k)[0] for k in ("high_sessions", "low_sessions"))


def risk_bucket(p: Column, flag: Column, policy: Policy | None = None) -> Column:
    """FE6: flag true -> high; p null -> medium; p < low -> low; p < medium -> medium; else high."""
    low, med = churn_thresholds(policy)
    return (
        F.when(F.coalesce(flag, F.lit(False)), F.lit("high"))
        .when(p.isNull(), F.lit("medium"))
        .when(p < F.lit(low), F.lit("low"))
        .when(p < F.lit(med), F.lit("medium"))
        .otherwise(F.lit("high"))
    )


def usage_level(sessions_total: Column, policy: Policy | None = None) -> Column:
    high, low = usage_thresholds(policy)
    s = F.coalesce(sessions_total.cast("long"), F.lit(0).cast("long"))
    return F.when(s >= high, F.lit("high")).when(s <= low, F.lit("low")).otherwise(F.lit("medium"))


def rule_features(stats: DataFrame, scores: DataFrame, revenue: DataFrame, ca_threshold: DataFrame,
                  reference_date: DataFrame, policy: Policy | None = None, window_days: int = 30) -> DataFrame:
    """FE5: churn_risk (missing -> medium), usage_level, ca_total_high (>= threshold),
    recent_one_shot (0 <= ref - most_recent <= window_days) for every client in ``stats``.

    ``scores``: client_id, churn_probability, churn (may miss clients);
    ``revenue``: client_id, most_recent_date; ``ca_threshold`` and
    ``reference_date`` are one-row frames (broadcast, size 1)."""
    sc = scores.select("client_id", "churn_probability", "churn")
    rv = revenue.select("client_id", "most_recent_date")
    j = (
        stats.join(sc, "client_id", "left")
        .join(rv, "client_id", "left")
        .crossJoin(F.broadcast(ca_threshold.select("ca_threshold")))
        .crossJoin(F.broadcast(reference_date.select(F.col(reference_date.columns[0]).alias("_ref"))))
    )
    delta = F.datediff("_ref", "most_recent_date")
    return j.select(
        "*",
        F.when(F.col("churn_probability").isNull() & F.col("churn").isNull(), F.lit("medium"))
        .otherwise(risk_bucket(F.col("churn_probability"), F.col("churn"), policy)).alias("churn_risk"),
        usage_level(F.col("sessions_total"), policy).alias("usage_level"),
        (F.coalesce(F.col("ca_total"), F.lit(0.0)) >= F.col("ca_threshold")).alias("ca_total_high"),
        F.coalesce((delta >= 0) & (delta <= window_days), F.lit(False)).alias("recent_one_shot"),
    ).drop("_ref")


# ---------------------------------------------------------------- compiler
FEATURE_TYPES = {"churn_risk": str, "usage_level": str, "ca_total_high": bool, "recent_one_shot": bool}
_ALIASES = {"true": True, "false": False, "null": None}


class UnsafeExpressionError(Exception):
    """The expression uses something the compiler has no case for."""


@dataclass
class _Operand:
    col: Column | None  # feature column, or None for a literal
    kind: Any           # python type of the feature / literal
    value: Any = None   # literal value


def _operand(node: ast.AST, features: dict[str, type]) -> _Operand:
    if isinstance(node, ast.Name):
        if node.id in features:
            return _Operand(F.col(node.id), features[node.id])
        if node.id in _ALIASES:
            v = _ALIASES[node.id]
            return _Operand(None, type(v), v)
        raise NameError(f"name '{node.id}' is not defined")
    if isinstance(node, ast.Constant):
        return _Operand(None, type(node.value), node.value)
    raise UnsafeExpressionError(f"no operand: {ast.unparse(node)}")


def _same_kind(a: type, b: type) -> bool:
    num = (bool, int, float)
    return a is b or (a in num and b in num)


def _eq(a: _Operand, b: _Operand) -> Column:
    """Python ``==``: None == None is true, mixed types are unequal (not an error)."""
    if a.col is None and b.col is None:
        return F.lit(a.value == b.value)
    if a.col is None:
        a, b = b, a
    if b.col is None:
        if b.value is None:
            return a.col.isNull()
        if not _same_kind(a.kind, b.kind):
            return F.lit(False)
        return F.coalesce(a.col == F.lit(b.value), F.lit(False))
    if not _same_kind(a.kind, b.kind):
        return a.col.isNull() & b.col.isNull()
    return a.col.eqNullSafe(b.col)


def _in(a: _Operand, items: list[_Operand]) -> Column:
    out = F.lit(False)
    for it in items:
        out = out | _eq(a, it)
    return out


def _compile_node(node: ast.AST, features: dict[str, type]) -> Column:
    if isinstance(node, ast.Expression):
        return _compile_node(node.body, features)
    if isinstance(node, ast.BoolOp):
        parts = [_compile_node(v, features) for v in node.values]
        out = parts[0]
        for p in parts[1:]:
            out = (out & p) if isinstance(node.op, ast.And) else (out | p)
        return out
    if isinstance(node, ast.Compare):
        left = node.left
        out = None
        for op, right in zip(node.ops, node.comparators):
            a = _operand(left, features)
            if not isinstance(op, (ast.In, ast.NotIn, ast.Eq, ast.NotEq)):
                raise UnsafeExpressionError(f"no comparison: {type(op).__name__}")
            if isinstance(op, (ast.In, ast.NotIn)):
                if not isinstance(right, (ast.List, ast.Tuple)):
                    raise UnsafeExpressionError("membership needs a literal list")
                c = _in(a, [_operand(e, features) for e in right.elts])
                c = ~c if isinstance(op, ast.NotIn) else c
            else:
                c = _eq(a, _operand(right, features))
                c = ~c if isinstance(op, ast.NotEq) else c
            out = c if out is None else (out & c)
            left = right
        return out
    if isinstance(node, (ast.Name, ast.Constant)):  # bare truthiness
        o = _operand(node, features)
        if o.col is None:
            return F.lit(bool(o.value))
        if o.kind is bool:
            return F.coalesce(o.col, F.lit(False))
        return F.coalesce(F.length(o.col) > 0, F.lit(False))
    raise UnsafeExpressionError(f"no condition: {ast.unparse(node)}")


def compile_rule(expr: str, features: dict[str, type] = FEATURE_TYPES) -> Column:
    """Compile a policy expression (==, !=, and, or, in, not in over feature
    names and literals) into a null-safe boolean Column.  Disallowed syntax
    raises ``UnsafeExpressionError``; an unknown feature raises ``NameError``."""
    try:
        tree = ast.parse(expr, mode="eval")
    except SyntaxError as e:
        raise UnsafeExpressionError(f"cannot be read as a condition: {expr!r}") from e
    return F.coalesce(_compile_node(tree, features), F.lit(False))


def apply_policy(features_df: DataFrame, policy: Policy, features: dict[str, type] = FEATURE_TYPES) -> DataFrame:
    """First matching rule by ascending priority (struct column ``rule``, null when none).
    Rules with disallowed syntax are skipped, like the reference engine."""
    branches = []
    for r in policy.rules:
        try:
            cond = compile_rule(r.expr, features)
        except UnsafeExpressionError:
            continue
        branches.append(F.when(cond, F.struct(
            F.lit(r.name).alias("name"), F.lit(r.priority).alias("priority"),
            F.lit(r.action).alias("action"), F.lit(r.rationale).alias("rationale"),
            F.lit(r.rule_index).alias("rule_index"),
        )))
    empty = F.lit(None).cast(T.StructType([
        T.StructField("name", T.StringType()), T.StructField("priority", T.IntegerType()),
        T.StructField("action", T.StringType()), T.StructField("rationale", T.StringType()),
        T.StructField("rule_index", T.IntegerType()),
    ]))
    rule = F.coalesce(*branches, empty) if branches else empty
    return features_df.withColumn("rule", rule)


# fixed values: decision texts
NO_RULE_RATIONALE = "Aucune règle métier déclenchée"
DEFAULT_RATIONALE = "Règle métier déclenchée"
NO_RULE_MISSING = "signal client insuffisant"


def decide_action(with_rule: DataFrame) -> DataFrame:
    """Decision record from the matched rule (``apply_policy`` output)."""
    has = F.col("rule").isNotNull()
    rat = F.trim(F.col("rule.rationale"))
    return with_rule.select(
        "*",
        F.when(has, F.col("rule.action")).otherwise(F.lit("no_action")).alias("action"),
        F.when(has, F.col("rule.priority").cast("string")).otherwise(F.lit("low")).alias("priority"),
        F.when(~has, F.array(F.lit(NO_RULE_RATIONALE)))
        .when(F.length(rat) > 0, F.array(rat))
        .otherwise(F.array(F.lit(DEFAULT_RATIONALE))).alias("rationale"),
        F.when(has, F.lit("medium")).otherwise(F.lit("low")).alias("confidence"),
        F.when(has, F.array().cast("array<string>")).otherwise(F.array(F.lit(NO_RULE_MISSING))).alias("missing_data"),
    ).drop("rule")


def action_mix(decisions: DataFrame) -> DataFrame:
    """D3: decisions per action x plan."""
    return decisions.groupBy("action", "plan").agg(F.count(F.lit(1)).alias("n_clients"))
