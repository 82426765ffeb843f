"""Prompt templates as text, compiled to column expressions.

A template is text with ``{{ value }}``, ``{% if a == "x" %} ... {% elif ... %} ... {% else %} ... {% endif %}`` and one ``|||``
between the prompt and the target. A value is a string in quotes, a number, a column, a field (``a.b``), a place of a list
(``choices[label]``, ``a[0]``), or one of those joined (``a | join(", ")``). A condition is ``==``, ``!=``, ``not`` or a value that is neither null, empty nor zero.

A null shows as nothing and equals nothing; so does a place that a list doesn't have. Both sides are trimmed.
Columns may hold the bar: they are put in after the text is cut. Nothing is evaluated but this grammar.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorecraft.functions.text import stripped

BAR = "|||"
#: What stands for the bar, and for the context, in a template that makes templates.
PIPE, COPY = "\n[pipe]\n", "copy_context"
TOKEN = re.compile(r"""\s*(?:(?P<text>"[^"]*"|'[^']*')|(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<sign>==|!=|[.\[\]|()]))""")


@dataclass(frozen=True)
class Text:
    text: str


@dataclass(frozen=True)
class Constant:
    value: str | int


@dataclass(frozen=True)
class Name:
    path: tuple[str, ...]


@dataclass(frozen=True)
class Place:
    items: object
    at: object


@dataclass(frozen=True)
class Joined:
    items: object
    by: str


@dataclass(frozen=True)
class Compare:
    left: object
    right: object
    equal: bool


@dataclass(frozen=True)
class Not:
    value: object


@dataclass(frozen=True)
class Show:
    value: object


@dataclass(frozen=True)
class If:
    branches: tuple[tuple[object, tuple], ...]
    rest: tuple


class _Reader:
    """The tokens of one value or condition."""

    def __init__(self, text: str):
        self.tokens, at, text = [], 0, text.strip()
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                raise ValueError(f"not a value: {text!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def take(self, *signs: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][1] in signs and self.tokens[self.at][0] in ("sign", "name"):
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def must(self, sign: str) -> None:
        if not self.take(sign):
            raise ValueError(f"{sign} is missing")

    def next(self) -> tuple[str, str]:
        if self.at == len(self.tokens):
            raise ValueError("a value is missing")
        self.at += 1
        return self.tokens[self.at - 1]

    def value(self):
        kind, word = self.next()
        if kind == "text":
            out = Constant(word[1:-1])
        elif kind == "number":
            out = Constant(int(word))
        elif kind == "name":
            out = Name((word,))
        else:
            raise ValueError(f"not a value: {word}")
        while sign := self.take(".", "[", "|"):
            if sign == ".":
                if not isinstance(out, Name):
                    raise ValueError("only a column has fields")
                out = Name((*out.path, self.next()[1]))
            elif sign == "[":
                out = Place(out, self.value())
                self.must("]")
            else:
                self.must("join")
                self.must("(")
                kind, word = self.next()
                if kind != "text":
                    raise ValueError("join takes a text")
                self.must(")")
                out = Joined(out, word[1:-1])
        return out

    def condition(self):
        if self.take("not"):
            return Not(self.condition())
        left = self.value()
        sign = self.take("==", "!=")
        return Compare(left, self.value(), sign == "==") if sign else left

    def end(self, found):
        if self.at != len(self.tokens):
            raise ValueError(f"unexpected: {self.tokens[self.at][1]}")
        return found


def parse(template: str) -> tuple:
    """The nodes of a template."""
    parts = re.split(r"(\{\{.*?\}\}|\{%.*?%\})", template, flags=re.S)
    stack: list[dict] = [{"done": [], "nodes": []}]
    for part in parts:
        top = stack[-1]
        if part.startswith("{{"):
            reader = _Reader(part[2:-2])
            top["nodes"].append(Show(reader.end(reader.value())))
        elif part.startswith("{%"):
            word, _, rest = part[2:-2].strip().partition(" ")
            if word == "if":
                reader = _Reader(rest)
                stack.append({"done": [], "when": reader.end(reader.condition()), "nodes": []})
                continue
            if "when" not in top:
                raise ValueError(f"{word} without an if")
            if word in ("elif", "else"):
                if top["when"] is None:
                    raise ValueError(f"{word} after else")
                top["done"].append((top["when"], tuple(top["nodes"])))
                reader = _Reader(rest)
                top["when"], top["nodes"] = (reader.end(reader.condition()) if word == "elif" else None), []
            elif word == "endif":
                stack.pop()
                last = tuple(top["nodes"])
                made = If(tuple(top["done"]), last) if top["when"] is None else If((*top["done"], (top["when"], last)), ())
                stack[-1]["nodes"].append(made)
            else:
                raise ValueError(f"unknown: {word}")
        elif part:
            top["nodes"].append(Text(part))
    if len(stack) > 1:
        raise ValueError("an if has no end")
    return tuple(stack[0]["nodes"])


def cut(nodes: tuple) -> tuple[tuple, tuple]:
    """The nodes before and after the bar; without one there is no target. A second bar is text of the target."""
    for i, node in enumerate(nodes):
        if isinstance(node, Text) and BAR in node.text:
            before, after = node.text.split(BAR, 1)
            return (*nodes[:i], Text(before)), (Text(after), *nodes[i + 1 :])
    return nodes, ()


def _value(node, columns: Mapping[str, Column]) -> Column:
    if isinstance(node, Constant):
        return F.lit(node.value)
    if isinstance(node, Name):
        if node.path[0] not in columns:
            raise KeyError(f"the template asks for {node.path[0]}")
        out = columns[node.path[0]]
        for f in node.path[1:]:
            out = out.getField(f)
        return out
    if isinstance(node, Place):
        return F.get(_value(node.items, columns), _value(node.at, columns).cast("int"))
    if isinstance(node, Joined):
        return F.array_join(F.transform(_value(node.items, columns), lambda x: x.cast("string")), node.by)
    raise TypeError(node)


def _holds(node, columns: Mapping[str, Column]) -> Column:
    if isinstance(node, Not):
        return ~_holds(node.value, columns)
    if isinstance(node, Compare):
        same = F.coalesce(_value(node.left, columns).cast("string") == _value(node.right, columns).cast("string"), F.lit(False))
        return same if node.equal else ~same
    text = F.coalesce(_value(node, columns).cast("string"), F.lit(""))
    return ~text.isin("", "0", "false", "[]", "0.0")


def shown(nodes: tuple, columns: Mapping[str, Column]) -> Column:
    """The text of the nodes as a column."""
    parts = []
    for node in nodes:
        if isinstance(node, Text):
            parts.append(F.lit(node.text))
        elif isinstance(node, Show):
            parts.append(F.coalesce(_value(node.value, columns).cast("string"), F.lit("")))
        else:
            out = shown(node.rest, columns)
            for condition, branch in reversed(node.branches):
                out = F.when(_holds(condition, columns), shown(branch, columns)).otherwise(out)
            parts.append(out)
    return F.concat(*parts) if parts else F.lit("")


@dataclass(frozen=True)
class TextTemplate:
    """A parsed template with its answer choices, which it may show as ``answer_choices``."""

    source: tuple
    target: tuple
    choices: tuple[str, ...] = ()

    @staticmethod
    def of(text: str, choices: str | None = None) -> "TextTemplate":
        """``choices`` are separated by bars."""
        return TextTemplate(*cut(parse(text)), tuple(c.strip() for c in choices.split(BAR)) if choices else ())

    def apply(self, **columns: Column) -> Column:
        """(input, output) of columns."""
        every = {"answer_choices": F.array(*map(F.lit, self.choices)).cast("array<string>")} | columns
        return F.struct(stripped(shown(self.source, every)).alias("input"), stripped(shown(self.target, every)).alias("output"))


def _masked(nodes: tuple, value) -> tuple[tuple, bool]:
    out, found = [], False
    for node in nodes:
        if isinstance(node, Show) and node.value == value:
            out.append(Show(Name((COPY,))))
            found = True
        elif isinstance(node, If):
            branches = []
            for condition, branch in node.branches:
                own, hit = _masked(branch, value)
                branches.append((condition, own))
                found |= hit
            rest, hit = _masked(node.rest, value)
            found |= hit
            out.append(If(tuple(branches), rest))
        else:
            out.append(node)
    return tuple(out), found


def masked(template: TextTemplate, context: str) -> TextTemplate | None:
    """The template that asks for the whole of ``template``: its input is the ``context`` (``{{ a.b }}``, white space doesn't matter), its output the rest with
    ``copy_context`` in the place of the context and a pipe in that of the bar. None if ``template`` doesn't show the context."""
    own = parse(context)
    if len(own) != 1 or not isinstance(own[0], Show):
        raise ValueError("the context must be one value")
    source, found = _masked(template.source, own[0].value)
    target, also = _masked(template.target, own[0].value)
    return TextTemplate(own, (*source, Text(PIPE), *target), template.choices) if found or also else None


_THREE = '{% if label == "REFUTES" %} No {% elif label == "SUPPORTS" %} Yes {% else %} Maybe {% endif %}'
_TRUTH = '{% if label == "REFUTES" %} False {% elif label == "SUPPORTS" %} True {% else %} Inconclusive {% endif %}'
_RELATED = '{% if answer == "Relevant" %} Yes {% else %} No {% endif %}'
#: Templates of the evaluation sets by (set, configuration) and name: the text and the answer choices. Fixed are the fields, the words that labels stand for and
#: their order (a claim's label 0 is No, 1 Yes, 2 Maybe); the wording is this library's.
TEXTS: dict[tuple[str, str | None], dict[str, tuple[str, str | None]]] = {
    ("contract_nli", None): {
        "follows": ('Contract: {{premise}}\nDoes it follow that "{{hypothesis}}"? Reply yes, no or maybe.|||{{answer_choices[label]}}', "No ||| Yes ||| Maybe"),
        "read": ('Read this clause. {{premise}}\n\nClaim: {{hypothesis}}\nDoes the clause bear the claim out (yes, no, maybe)?|||{{answer_choices[label]}}', "No ||| Yes ||| Maybe"),
        "given": ('Given only {{premise}}, the sentence "{{hypothesis}}" is true, false or inconclusive:|||{{answer_choices[label]}}', "False ||| True ||| Inconclusive"),
        "judge": ('{{premise}}\n\nJudge "{{hypothesis}}" by the clause: true, false or inconclusive?|||{{ answer_choices[label] }}', "False ||| True ||| Inconclusive"),
        "ask": ('{{premise}} Would a careful reader agree that "{{hypothesis}}"? Yes, no, or maybe? ||| {{ answer_choices[label] }}', "No ||| Yes ||| Maybe"),
    },
    ("vitaminc", None): {
        "follows": ('Evidence: {{evidence}}\nDoes it follow that "{{claim}}"? Reply yes, no or maybe.|||' + _THREE, "No ||| Yes ||| Maybe"),
        "read": ("Read this evidence. {{evidence}}\n\nClaim: {{claim}}\nDoes the evidence bear the claim out (yes, no, maybe)?|||" + _THREE, "No ||| Yes ||| Maybe"),
        "given": ('Given only {{evidence}}, the sentence "{{claim}}" is true, false or inconclusive:|||' + _TRUTH, "False ||| True ||| Inconclusive"),
        "judge": ('{{evidence}}\n\nJudge "{{claim}}" by the evidence: true, false or inconclusive?|||' + _TRUTH, "False ||| True ||| Inconclusive"),
        "ask": ('{{evidence}} Would a careful reader agree that "{{claim}}"? Yes, no, or maybe? |||' + _THREE, "No ||| Yes ||| Maybe"),
    },
    ("pubmed_qa", None): {
        "passage": ('Passage: {{ context.contexts | join(" ") }}\n\nQuestion: {{question}}\nReply YES, NO or MAYBE. |||\n{{final_decision}}', "yes ||| no ||| maybe"),
        "reader": ('{{question}}\nDecide it by what follows.\n\n{{ context.contexts | join(" ") }}\n\nYES, NO or MAYBE? |||\n{{final_decision}}', "yes ||| no ||| maybe"),
        "abstract": ('Abstract: {{ context.contexts | join(" ") }}\nWhat does it say on "{{question}}": YES, NO or MAYBE?|||\n{{final_decision}}', "yes ||| no ||| maybe"),
        "first": ('Question: "{{question}}"\n\nSource: {{ context.contexts | join(" ") }}\n\nOne word, YES, NO or MAYBE:|||\n{{final_decision}}', "yes ||| no ||| maybe"),
        "study": ('A study reports: {{ context.contexts | join(" ") }}\n\nSo, {{question}} YES, NO or MAYBE?|||\n{{final_decision}}', "yes ||| no ||| maybe"),
    },
    ("privacy_policy_qa", None): {
        "word": ("Policy: {{text}}\nQuestion: {{question}}\nRelevant or Irrelevant?|||{{answer}}", "Relevant|||Irrelevant"),
        "touches": ('Does the policy text\n"{{text}}"\ntouch on "{{question}}"?|||' + _RELATED, "Yes|||No"),
        "reply": ('Someone asks "{{question}}". Is this part of the reply?\n{{text}}|||' + _RELATED, "Yes|||No"),
        "counsel": ("You advise on privacy. Question: {{question}}\nPolicy: {{text}}\nDoes the policy speak to it?|||" + _RELATED, "Yes|||No"),
        "pair": ("{{question}}\n{{text}}\nDo the two lines belong together?|||" + _RELATED, "Yes|||No"),
    },
    ("privacy_qa", None): {"word": ("Policy: {{text}}\nQuestion: {{question}}\nRelevant or Irrelevant?|||{{answer}}", "Relevant|||Irrelevant")},
    ("bio_qa", None): {"answer": ("{{context}}\n\nQuestion: {{question}}\nAnswer: ||| {{answer}}", None)},
    ("hotpot_qa", None): {"answer": ("{{question}}|||{{answer}}", None)},
}
