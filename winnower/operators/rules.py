"""Declarative rules and profiles, compiled to one projection.

A rule fails closed: a missing or unreadable value breaks it, except that an absent pattern flag satisfies
``lacks_pattern``.  A profile passes if its hard violations are within its tolerance; soft rules never count.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace
from functools import reduce
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnower.functions.columns import closed, number

#: Profiles with more rules than this have no failure mask: bit 63 is the sign.
MASK_RULES = 63


def _pair(rule: Rule) -> tuple[float, float]:
    low, high = (float(x) for x in rule.threshold)
    if low > high:
        raise ValueError(f"{rule.id}: lower bound {low} above upper bound {high}")
    return low, high


def _members(rule: Rule) -> list[Any]:
    if not isinstance(rule.threshold, (list, tuple, set, frozenset)):
        raise ValueError(f"{rule.id}: {rule.operator} takes a list")
    return list(rule.threshold)


_COMPARE = {
    "<": lambda v, r: v < float(r.threshold),
    "<=": lambda v, r: v <= float(r.threshold),
    ">": lambda v, r: v > float(r.threshold),
    ">=": lambda v, r: v >= float(r.threshold),
    "between_inclusive": lambda v, r: v.between(*_pair(r)),
    "between_exclusive": lambda v, r: (v > _pair(r)[0]) & (v < _pair(r)[1]),
}
_MATCH = {
    "==": lambda v, r: v == F.lit(r.threshold),
    "!=": lambda v, r: v != F.lit(r.threshold),
    "in": lambda v, r: v.isin(_members(r)),
    "not_in": lambda v, r: ~v.isin(_members(r)),
}
PATTERN = ("contains_substructure", "does_not_contain_substructure")
OPERATORS = (*_COMPARE, *_MATCH, *PATTERN)


@dataclass(frozen=True)
class Rule:
    """One condition on a descriptor column."""

    id: str
    descriptor: str
    operator: str
    threshold: Any = None
    severity: str = "hard"
    failure_code: str = ""

    def __post_init__(self) -> None:
        if self.operator not in OPERATORS:
            raise ValueError(f"{self.id}: unknown operator {self.operator!r}")
        if self.severity not in ("hard", "soft"):
            raise ValueError(f"{self.id}: unknown severity {self.severity!r}")
        if self.operator.startswith("between"):
            _pair(self)
        if self.operator in ("in", "not_in"):
            _members(self)

    @property
    def code(self) -> str:
        return self.failure_code or self.id.upper()

    @property
    def bounds(self) -> tuple[float | None, float | None]:
        """(lower, upper) limits, for reports."""
        if self.operator in ("<", "<="):
            return None, float(self.threshold)
        if self.operator in (">", ">="):
            return float(self.threshold), None
        if self.operator.startswith("between"):
            return _pair(self)
        if self.operator == "==" and isinstance(self.threshold, (int, float)):
            return float(self.threshold), float(self.threshold)
        return None, None

    def satisfied(self) -> Column:
        """True or false, never NULL."""
        value = F.col(self.descriptor)
        if self.operator == "contains_substructure":
            return closed(value.cast("boolean"))
        if self.operator == "does_not_contain_substructure":
            return ~closed(value.cast("boolean"))
        if self.operator in _COMPARE:
            return closed(_COMPARE[self.operator](number(value), self))
        return closed(_MATCH[self.operator](value, self))

    def describe(self) -> str:
        return f"{self.descriptor} {self.operator.replace('_', ' ')} {self.threshold}"


@dataclass(frozen=True)
class Profile:
    """A versioned group of rules; ``max_violations`` None means that all must hold."""

    id: str
    rules: tuple[Rule, ...]
    max_violations: int | None = None
    name: str = ""
    version: str = "1"
    notes: dict[str, Any] = field(default_factory=dict, compare=False)

    def __post_init__(self) -> None:
        ids = [r.id for r in self.rules]
        if not ids or len(set(ids)) != len(ids):
            raise ValueError(f"{self.id}: rule ids must be present and distinct")
        if self.max_violations is not None and not 0 <= self.max_violations < max(1, len(ids)):
            raise ValueError(f"{self.id}: a tolerance of {self.max_violations} can't fail")

    def tolerating(self, violations: int) -> Profile:
        return replace(self, max_violations=violations)

    def with_thresholds(self, thresholds: dict[str, Any]) -> Profile:
        """The same rules with other limits, by rule id."""
        unknown = set(thresholds) - {r.id for r in self.rules}
        if unknown:
            raise ValueError(f"{self.id}: no rules {sorted(unknown)}")
        return replace(self, rules=tuple(replace(r, threshold=thresholds.get(r.id, r.threshold)) for r in self.rules))

    def columns(self) -> dict[str, Column]:
        broken = [~r.satisfied() for r in self.rules]
        hard = reduce(lambda a, b: a + b, [b.cast("long") for r, b in zip(self.rules, broken) if r.severity == "hard"], F.lit(0).cast("long"))
        soft = reduce(lambda a, b: a + b, [b.cast("long") for r, b in zip(self.rules, broken) if r.severity == "soft"], F.lit(0).cast("long"))
        bits = [F.when(b, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i, b in enumerate(broken[:MASK_RULES])]
        mask = reduce(lambda a, b: a.bitwiseOR(b), bits) if len(broken) <= MASK_RULES else F.lit(None).cast("long")
        return {
            f"{self.id}__passed": hard <= F.lit(self.max_violations or 0),
            f"{self.id}__violations": hard,
            f"{self.id}__soft_violations": soft,
            f"{self.id}__mask": mask,
        }


def check_columns(df: DataFrame, profiles: list[Profile]) -> None:
    missing = {r.descriptor for p in profiles for r in p.rules} - set(df.columns)
    if missing:
        raise ValueError(f"rules need columns that are not there: {sorted(missing)}")
    ids = [p.id for p in profiles]
    if len(set(ids)) != len(ids):
        raise ValueError("profile ids must be distinct")


def evaluate(df: DataFrame, profiles: list[Profile]) -> DataFrame:
    """Verdict, counts and mask of every profile, in one projection."""
    check_columns(df, profiles)
    return df.withColumns({n: c for p in profiles for n, c in p.columns().items()})


def failures(df: DataFrame, profiles: list[Profile], record_id: str = "record_id") -> DataFrame:
    """A row per broken rule: ``profile_id, rule_id, failure_code, observed_value, lower_limit, upper_limit``."""
    check_columns(df, profiles)
    rows = []
    for p in profiles:
        for r in p.rules:
            low, high = r.bounds
            row = F.struct(
                F.lit(p.id).alias("profile_id"), F.lit(r.id).alias("rule_id"), F.lit(r.code).alias("failure_code"), number(r.descriptor).alias("observed_value"),
                F.lit(low).cast("double").alias("lower_limit"), F.lit(high).cast("double").alias("upper_limit"),
            )
            rows.append(F.when(~r.satisfied(), row))
    broken = F.filter(F.array(*rows), lambda x: x.isNotNull())
    return df.select(F.col(record_id), F.explode(broken).alias("f")).select(record_id, "f.*")


def long_status(df: DataFrame, profiles: list[Profile], record_id: str = "record_id") -> DataFrame:
    """A row per record and profile: ``profile_id, passed, violations, soft_violations, mask``."""
    rows = [
        F.struct(F.lit(p.id).alias("profile_id"), *(c.alias(n.removeprefix(f"{p.id}__")) for n, c in p.columns().items()))
        for p in profiles
    ]
    return df.select(record_id, F.explode(F.array(*rows)).alias("s")).select(record_id, "s.*")


def failure_texts(found: DataFrame, record_id: str = "record_id") -> DataFrame:
    """Per record: distinct profiles and codes, sorted, joined by ``, ``."""
    return found.groupBy(record_id).agg(
        F.array_join(F.array_sort(F.collect_set("profile_id")), ", ").alias("failed_profiles"),
        F.array_join(F.array_sort(F.collect_set("failure_code")), ", ").alias("failure_codes"),
    )


def from_dict(spec: dict[str, Any]) -> Profile:
    """A profile from its JSON form: ``id, rules [...], policy {type, n}``."""
    policy = spec.get("policy", {"type": "all_rules"})
    if policy.get("type") not in ("all_rules", "max_violations"):
        raise ValueError(f"{spec.get('id')}: unknown policy {policy}")
    rules = tuple(Rule(**{k: tuple(v) if isinstance(v, list) else v for k, v in r.items()}) for r in spec["rules"])
    tolerance = int(policy.get("n", policy.get("max_violations", 0))) if policy["type"] == "max_violations" else None
    return Profile(spec["id"], rules, tolerance, spec.get("name", ""), str(spec.get("version", "1")))


def load_profiles(*folders: str) -> dict[str, Profile]:
    """Profiles from JSON files; later folders override earlier ones by id, one folder must not repeat an id."""
    found: dict[str, Profile] = dict(BUILT_IN)
    for folder in folders:
        own: dict[str, Profile] = {}
        for path in sorted(Path(folder).glob("*.json")):
            profile = from_dict(json.loads(path.read_text()))
            if profile.id in own:
                raise ValueError(f"{folder} has {profile.id} twice")
            own[profile.id] = profile
        found |= own
    return found


def _built_in() -> dict[str, Profile]:
    # Published screening limits by profile: violations allowed, prefix of the failure codes, (descriptor, operator, limit, code).
    limits: dict[str, tuple[int | None, str, list[tuple[str, str, Any, str]]]] = {
        "lipinski": (1, "LIP", [("mol_wt", "<=", 500, "MW_HIGH"), ("rdkit_wlogp", "<=", 5, "LOGP_HIGH"), ("hbd", "<=", 5, "HBD_HIGH"), ("hba", "<=", 10, "HBA_HIGH")]),
        "veber": (None, "VEB", [("rotatable_bonds", "<=", 10, "ROTB_HIGH"), ("tpsa", "<=", 140, "TPSA_HIGH")]),
        "ghose": (None, "GHO", [
            ("mol_wt", ">=", 160, "MW_LOW"), ("mol_wt", "<=", 480, "MW_HIGH"), ("rdkit_wlogp", ">=", -0.4, "LOGP_LOW"), ("rdkit_wlogp", "<=", 5.6, "LOGP_HIGH"),
            ("mol_mr", ">=", 40, "MR_LOW"), ("mol_mr", "<=", 130, "MR_HIGH"), ("total_atom_count", ">=", 20, "ATOMS_LOW"), ("total_atom_count", "<=", 70, "ATOMS_HIGH")]),
        "egan": (None, "EGA", [("rdkit_wlogp", "<=", 5.88, "LOGP_HIGH"), ("tpsa", "<=", 131.6, "TPSA_HIGH")]),
        "muegge": (None, "MUE", [
            ("mol_wt", ">=", 200, "MW_LOW"), ("mol_wt", "<=", 600, "MW_HIGH"), ("rdkit_wlogp", ">=", -2, "LOGP_LOW"), ("rdkit_wlogp", "<=", 5, "LOGP_HIGH"),
            ("tpsa", "<=", 150, "TPSA_HIGH"), ("ring_count", "<=", 7, "RINGS_HIGH"), ("carbon_count", ">", 4, "CARBON_LOW"), ("heteroatom_count", ">", 1, "HETERO_LOW"),
            ("rotatable_bonds", "<=", 15, "ROTB_HIGH"), ("hba", "<=", 10, "HBA_HIGH"), ("hbd", "<=", 5, "HBD_HIGH")]),
        "lead_like": (None, "LL", [("mol_wt", ">=", 250, "MW_LOW"), ("mol_wt", "<=", 350, "MW_HIGH"), ("rdkit_wlogp", "<=", 3.5, "LOGP_HIGH"), ("rotatable_bonds", "<=", 7, "ROTB_HIGH")]),
        "ro3_core": (None, "RO3", [("mol_wt", "<=", 300, "MW_HIGH"), ("rdkit_wlogp", "<=", 3, "LOGP_HIGH"), ("hbd", "<=", 3, "HBD_HIGH"), ("hba", "<=", 3, "HBA_HIGH")]),
        "ro3_extended": (None, "RO3", [
            ("mol_wt", "<=", 300, "MW_HIGH"), ("rdkit_wlogp", "<=", 3, "LOGP_HIGH"), ("hbd", "<=", 3, "HBD_HIGH"), ("hba", "<=", 3, "HBA_HIGH"),
            ("rotatable_bonds", "<=", 3, "ROTB_HIGH"), ("tpsa", "<=", 60, "TPSA_HIGH")]),
        "cns_like": (1, "CNS", [
            ("mol_wt", "<=", 400, "MW_HIGH"), ("tpsa", "<=", 90, "TPSA_HIGH"), ("hbd", "<=", 3, "HBD_HIGH"), ("rdkit_wlogp", ">=", 1, "LOGP_LOW"),
            ("rdkit_wlogp", "<=", 4, "LOGP_HIGH"), ("rotatable_bonds", "<=", 8, "ROTB_HIGH"), ("no_count", "<=", 5, "NO_HIGH")]),
        "beyond_ro5": (None, "BRO5", [
            ("mol_wt", "<=", 1000, "MW_HIGH"), ("rdkit_wlogp", ">=", -2, "LOGP_LOW"), ("rdkit_wlogp", "<=", 10, "LOGP_HIGH"), ("hbd", "<=", 6, "HBD_HIGH"),
            ("hba", "<=", 15, "HBA_HIGH"), ("rotatable_bonds", "<=", 20, "ROTB_HIGH"), ("tpsa", "<=", 250, "TPSA_HIGH")]),
        "dockability_envelope": (None, "DOCK", [
            ("mol_wt", "between_inclusive", (120, 700), "MW_OUTSIDE"), ("tpsa", "<=", 200, "TPSA_HIGH"), ("hbd", "<=", 10, "HBD_HIGH"), ("hba", "<=", 16, "HBA_HIGH"),
            ("rotatable_bonds", "<=", 18, "ROTB_HIGH"), ("rdkit_wlogp", "between_inclusive", (-3, 8), "LOGP_OUTSIDE")]),
    }
    out = {}
    for name, (tolerance, prefix, rows) in limits.items():
        rules = tuple(Rule(f"{name}_{code.lower()}", d, op, t, failure_code=f"{prefix}_{code}") for d, op, t, code in rows)
        out[name] = Profile(name, rules, tolerance)
    return out


BUILT_IN = _built_in()
