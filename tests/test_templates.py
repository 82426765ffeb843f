"""Templates against an interpreter of the same grammar over Python values."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lorecraft.functions import templates as T
from lorecraft.functions.prompts import evaluation_templates
from lorecraft.functions.templates import TEXTS, TextTemplate, cut, masked, parse

ROWS = [
    {"a": "x", "b": None, "n": 1, "l": ["p", "q"], "s": {"t": "in ||| side", "v": ["1", "2"]}},
    {"a": "", "b": "y", "n": 7, "l": [], "s": {"t": None, "v": None}},
    {"a": "{{b}}", "b": "x", "n": 0, "l": ["only"], "s": None},
    {"a": None, "b": "", "n": None, "l": None, "s": {"t": "x", "v": []}},
]
SCHEMA = "a string, b string, n int, l array<string>, s struct<t:string, v:array<string>>"
CHOICES = "No ||| Yes"

values = st.sampled_from(["a", "b", "n", "s.t", "l[0]", "l[n]", "answer_choices[n]", 'l | join(", ")', 's.v | join("")', '"x"', "'quoted \"'", "1"])
conditions = st.one_of(values, st.tuples(values, st.sampled_from(["==", "!="]), values).map(" ".join), values.map(lambda v: f"not {v}"))
leaves = st.one_of(st.sampled_from(["text ", "\n", " | ", "100% {sure} ", "é"]), values.map(lambda v: "{{ " + v + "}}"))
bodies = st.recursive(
    st.lists(leaves, max_size=3).map("".join),
    lambda inner: st.tuples(inner, conditions, inner, st.booleans(), conditions, inner, st.booleans(), inner, inner).map(
        lambda p: p[0] + "{% if " + p[1] + " %}" + p[2] + ("{% elif " + p[4] + "%}" + p[5] if p[3] else "") + ("{% else %}" + p[7] if p[6] else "") + "{%endif%}" + p[8]
    ),
    max_leaves=4,
)


def value(node, row):
    if isinstance(node, T.Constant):
        return node.value
    if isinstance(node, T.Name):
        out = row
        for f in node.path:
            out = None if out is None else out[f]
        return out
    if isinstance(node, T.Place):
        items, at = value(node.items, row), value(node.at, row)
        return items[at] if items is not None and at is not None and 0 <= at < len(items) else None
    items = value(node.items, row)
    return None if items is None else node.by.join(items)


def holds(node, row):
    if isinstance(node, T.Not):
        return not holds(node.value, row)
    if isinstance(node, T.Compare):
        x, y = value(node.left, row), value(node.right, row)
        return (x is not None and y is not None and str(x) == str(y)) == node.equal
    x = value(node, row)
    return x is not None and str(x) not in ("", "0")


def show(nodes, row):
    out = ""
    for node in nodes:
        if isinstance(node, T.Text):
            out += node.text
        elif isinstance(node, T.Show):
            x = value(node.value, row)
            out += "" if x is None else str(x)
        else:
            out += show(next((b for c, b in node.branches if holds(c, row)), node.rest), row)
    return out


@settings(max_examples=40, deadline=None)
@given(bodies, bodies)
def test_against_an_interpreter(spark, source, target):
    df = spark.createDataFrame([tuple(r.values()) for r in ROWS], SCHEMA).coalesce(1)
    t = TextTemplate.of(f"{source}|||{target}", CHOICES)
    got = df.select(t.apply(**{c: F.col(c) for c in df.columns}).alias("t")).select("t.*").collect()
    for row, (left, right) in zip(ROWS, got):
        every = row | {"answer_choices": ["No", "Yes"]}
        before, after = cut(parse(f"{source}|||{target}"))
        assert (left, right) == (show(before, every).strip(), show(after, every).strip())


@pytest.mark.parametrize("text", ["{{ }}", "{{ a b }}", "{{ a | upper }}", "{% if a %}x", "{% endif %}", "{% else %}", "{% for a in b %}", "{% if a %}{% else %}{% else %}{% endif %}", "{{ 'a' . b }}", "{{ a[0 }}", "{{ __import__('os') }}"])
def test_what_is_no_template(text):
    with pytest.raises(ValueError):
        parse(text)


def test_labels_of_claims(spark):
    """Label 0 of a claim is No, 1 Yes, 2 Maybe."""
    book = evaluation_templates()
    assert set(book.gather("contract_nli")) == set(TEXTS["contract_nli", None]) and len(book.gather("vitaminc")) == 5
    df = spark.createDataFrame([(0, "REFUTES"), (1, "SUPPORTS"), (2, "NOT ENOUGH INFO"), (3, None)], "label int, word string").coalesce(1)
    nli = book.choose("contract_nli", None, "ask").apply(premise=F.lit("P."), hypothesis=F.lit("H"), label=F.col("label"))
    vitamin = book.choose("vitaminc", None, "given").apply(evidence=F.lit("E"), claim=F.lit("C"), label=F.col("word"))
    got = df.select(nli.alias("n"), vitamin.alias("v")).collect()
    assert [r["n"]["output"] for r in got] == ["No", "Yes", "Maybe", ""]
    assert [r["v"]["output"] for r in got] == ["False", "True", "Inconclusive", "Inconclusive"]
    with pytest.raises(KeyError):
        book.choose("hotpot_qa", None, "answer").apply(question=F.lit("?"))


def test_masks(one):
    t = TextTemplate.of("A {{  a.b}}{% if c %} {{ a.b }}{% endif %} B|||{{ c }}")
    m = masked(t, "{{a.b }}")
    x = one(m.apply(a=F.struct(F.lit("V").alias("b")), c=F.lit("C"), copy_context=F.lit("<>")))
    assert (x["input"], x["output"]) == ("V", "A <> <> B\n[pipe]\nC")
    assert masked(t, "{{ c }}") is not None and masked(t, "{{ d }}") is None
    with pytest.raises(ValueError):
        masked(t, "text")
