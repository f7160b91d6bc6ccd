"""Slugs and the log of changes to identities, against plain loops over states."""

import random
import re

from formloom.functions import dictionary
from formloom.plans.queries import OPERATORS

CHOICES = {}
for choice, answer, *_ in dictionary.CHOICES:
    CHOICES.setdefault(choice, set()).add(answer)


def slugs(spark, labels):
    df = spark.createDataFrame(list(enumerate(labels)), "ord long, label string")
    return [r.slug for r in OPERATORS["slugify"].apply(spark, slug_labels=df.repartition(3)).orderBy("ord").collect()]


def by_probing(labels):
    out = []
    for label in labels:
        base = re.sub("[^a-z0-9]+", "-", label.lower()).strip("-") or "identity"
        slug, n = base, 2
        while slug in out:
            slug, n = f"{base}-{n}", n + 1
        out.append(slug)
    return out


def test_a_label_may_hold_anothers_number(spark):
    assert slugs(spark, ["A", "A 2", "A"]) == ["a", "a-2", "a-3"]
    assert slugs(spark, ["A", "A", "A 2", "A 2"]) == ["a", "a-2", "a-2-2", "a-2-3"]
    assert slugs(spark, ["A 4", "A 2", "A", "A", "A", "A 03", "A 3", "", "?!", "A 1", "A 1"]) == ["a-4", "a-2", "a", "a-3", "a-5", "a-03", "a-3-2", "identity", "identity-2", "a-1", "a-1-2"]


def test_random_labels(spark):
    random.seed(6)
    labels = ["".join(random.choice(["A", "b", " 2", "-3", " 10", "!", " 02", "-1"]) for _ in range(random.randrange(0, 4))) for _ in range(600)]
    assert slugs(spark, labels) == by_probing(labels)


CHANGES = "library long, seq long, op string, slug string, key string, value string, label string"


def replayed(changes):
    """The state of one library after its changes, in order."""
    state, default = {}, ""

    def born(slug, label, kind):
        nonlocal default
        state[slug] = {"label": (label or "").strip() or slug[:1].upper() + slug[1:].lower(), "kind": kind if kind in ("person", "business") else "person", "prefers": [], "values": {}}
        if state[slug]["kind"] == "person":
            state[slug]["values"]["tax_classification"] = "individual"
        if len(state) == 1:
            default = slug

    for _, _, op, slug, key, value, label in changes:
        if op == "create" and slug not in state:
            born(slug, label, value)
        elif op == "set":
            if key not in {f[0] for f in dictionary.FIELDS} or key in dictionary.SENSITIVE or key in CHOICES and value and value not in CHOICES[key]:
                continue
            if slug not in state:
                born(slug, None, "person")
            state[slug]["values"][key] = value
        elif op == "delete" and slug in state:
            del state[slug]
            if slug == default:
                default = min(state, default="")
        elif slug in state and op == "set_kind" and value in ("person", "business"):
            state[slug] |= {"kind": value, "prefers": []}
        elif slug in state and op == "set_preference":
            group = {"ssn", "ein"} if key in ("ssn", "ein") else {key}
            state[slug]["prefers"] = [k for k in state[slug]["prefers"] if k not in group] + [key]
        elif slug in state and op == "rename" and value.strip():
            state[slug]["label"] = value.strip()
    out = {(s, "label", x["label"]) for s, x in state.items()} | {(s, "kind", x["kind"]) for s, x in state.items()}
    out |= {(s, "prefers", ",".join(x["prefers"])) for s, x in state.items() if x["prefers"]}
    out |= {(s, f"value:{k}", v) for s, x in state.items() for k, v in x["values"].items() if v}
    return out | ({(default, "default", "yes")} if default else set())


def state(spark, changes):
    made = {"changes": spark.createDataFrame(changes, CHANGES).repartition(3), "fields": spark.sql(dictionary.values_sql("fields")), "choices": spark.sql(dictionary.values_sql("choices"))}
    for name in ("lives", "default_identity", "identity_changelog"):
        made[name] = OPERATORS[name].apply(spark, **{x: made[x] for x in OPERATORS[name].inputs})
    return {tuple(r) for r in made["identity_changelog"].collect()}


def test_changes_in_order(spark):
    log = [
        (1, "create", "ann", None, "person", " Ann "), (2, "set_preference", "ann", "ein", None, None), (3, "set", "ann", "city", "Rome", None), (4, "create", "bob", None, "business", None),
        (5, "set", "ann", "ssn", "123", None), (6, "set", "ann", "filing_status", "nonsense", None), (7, "rename", "ann", None, "  ", None), (8, "delete", "ann", None, None, None),
        (9, "set_kind", "ann", None, "business", None), (10, "set", "ann", "zip", "1", None), (11, "set_preference", "bob", "ssn", None, None), (12, "set_preference", "bob", "ein", None, None), (13, "set", "bob", "city", "", None),
    ]
    got = state(spark, [(7, *x) for x in log])
    assert got == {
        (7, "ann", "label", "Ann"), (7, "ann", "kind", "person"), (7, "ann", "value:tax_classification", "individual"), (7, "ann", "value:zip", "1"),
        (7, "bob", "label", "Bob"), (7, "bob", "kind", "business"), (7, "bob", "prefers", "ein"), (7, "bob", "default", "yes"),
    }


def test_random_logs(spark):
    random.seed(7)
    log = []
    for seq in range(1500):
        op = random.choice(["create", "set", "set", "set", "set_kind", "set_preference", "rename", "delete"])
        key = random.choice(["ssn", "ein", "phone"]) if op == "set_preference" else random.choice(["city", "zip", "ssn", "nope", "filing_status", "tax_classification"])
        value = random.choice(["person", "business", "ghost"]) if op in ("create", "set_kind") else random.choice(["", " x ", "y", "single", "c_corp"])
        log.append((seq % 9, seq, op, f"p{random.randrange(4)}", key, value, random.choice([None, " ", "New"])))
    want = {(library, *x) for library in range(9) for x in replayed([c for c in log if c[0] == library])}
    assert state(spark, log) == want
