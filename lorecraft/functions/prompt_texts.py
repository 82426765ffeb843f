"""Wording of the prompts that the plans send; each has the named places that ``fill`` fills."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EXTRACT = """List the entities and the relations that the text states.
Entity types to use: {types}.
Reply with JSON only: {"entities": [{"name": "", "type": "", "description": ""}], "relations": [{"source": "", "target": "", "description": ""}]}
Text:
{text}"""
SUMMARISE = """Several descriptions of the same thing follow. Write one that keeps every fact and contradicts none.
{descriptions}"""
ALIGN = """Which of these names mean the same thing? Reply with a JSON list of lists of names; leave out names that stand alone.
{names}"""
QUESTION = """Write one question that needs all {n} passages to be answered. It must be clear without them.
{rules}
{sources}
Question:"""
#: What a question must be like, by the number of passages that it joins.
MODES = {
    1: "The passage alone decides it. It is closed and ends in one of: Yes, no, or maybe? | True, False, or Neither? | Correct, Incorrect, or Uncertain?",
    2: "It can't be answered from one passage: it compares or connects both. It is closed and ends in one of: Yes, no, or maybe? | True, False, or Neither? | Correct, Incorrect, or Uncertain?",
    3: "It needs a fact of each of the three passages, in steps that build on each other. It is closed and ends in one of: Yes, no, or maybe? | True, False, or Neither? | Correct, Incorrect, or Uncertain?",
    4: "It weighs all four passages against each other and asks for the conclusion. It is closed and ends in one of: Yes, no, or maybe? | True, False, or Neither? | Correct, Incorrect, or Uncertain?",
}
ENTITY_SUMMARY = """Read the document. Reply with JSON only: {"summary": "what it says, in full", "entities": ["everything of importance that it names or is about"]}
{text}"""
REASON_ALONE = """Think step by step, then answer in one sentence.
Question: {question}
Answer:"""
REASON_WITH = """Answer from the facts, and from what you know where they are silent. Think step by step.
Question: {question}
Facts:
{facts}
Answer:"""
RELEVANT = """Do the two passages belong to the same subject, so that a question can join them?
First: {first}
Second: {second}
Reply: **Relevance** Yes or **Relevance** No"""
ANSWER = """Answer from the passages alone. If they don't hold the answer, reply I CANNOT ANSWER.
{context}
Question: {question}
Answer:"""
RELATIONS = """Choose the relations that help to answer the question, with scores between 0 and 1 that add up to 1.
Write each as {name (Score: 0.5)}.
Question: {question}
Entity: {entity}
Relations: {relations}"""
ENTITIES = """Score how much each entity helps to answer the question, with decimals that add up to 1, in their order.
Question: {question}
Relation: {relation}
Entities: {entities}
Scores:"""
ENOUGH = """Do these facts suffice to answer the question? Reply {Yes} or {No}.
Question: {question}
Facts:
{facts}"""
PAIR = """Write a passage on how {a} and {b} are related in the text, and on what follows from it.
{text}"""
SELF_QUESTIONS = """Write {n} questions that the text answers, one a line, each after "Question:".
{text}"""
SELF_ANSWER = """Read the text and reply in the form "Question: ... Answer: ...".
{text}
Question: {question}"""


def fill(wording: str, **places: Column) -> Column:
    """The wording with columns in its places; other braces stay as they are."""
    out = F.lit(wording)
    for name, column in places.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(column.cast("string"), F.lit("")))
    return out
