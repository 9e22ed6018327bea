"""Small fact histories, and an oracle of the bitemporal rules in plain Python."""

from __future__ import annotations

from factloom.schema import FACTS, Family


def event(valid_from, commit_seq, op="P", part=0, entity=9, family=Family.VERTEX_STATE, prop=0, value=None, kind=5, lane="float64_value", **rest):
    row = {f: None for f in FACTS.fieldNames()}
    put = op == "P"
    row |= dict(part_id=part, fact_family=int(family), property_id=prop, entity_id=entity, valid_from=valid_from, commit_seq=commit_seq, operation=1 if put else 2, schema_epoch=1 if prop else 0, physical_type=0)
    if prop and put:
        row |= {"physical_type": kind, lane: value}
    return row | rest


def frame(spark, rows):
    return spark.createDataFrame([tuple(r[f] for f in FACTS.fieldNames()) for r in rows], FACTS)


def resolved(rows, t, s):
    """The event that holds, or None."""
    seen = [r for r in rows if r["valid_from"] <= t and r["commit_seq"] <= s]
    if not seen:
        return None
    best = max(seen, key=lambda r: (r["valid_from"], r["commit_seq"]))
    return best if best["operation"] == 1 else None


def neighbours(rows, t, s):
    """(observed, predecessor, successor) as valid times."""
    times = sorted({r["valid_from"] for r in rows if r["commit_seq"] <= s})
    return max((x for x in times if x <= t), default=None), max((x for x in times if x < t), default=None), min((x for x in times if x > t), default=None)
