"""Prompts for facts: a card for every intent says what is asked, a bank of styles how. Both compile to column expressions.

A card is a clause that follows "tell me": its slots are keys of the fact's seed. A style is a sentence around a clause. The style of a
fact is picked by a hash of its key, so styles are even over any table and the same on every run. A seed without a slot's key leaves the slot empty; an
intent without a card gets no prompt (null), which complete() in operators.seam refuses.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: intent: clause.
CARDS: dict[str, str] = {
    "A1": "what the function is called", "A2": "how many parameters it takes", "A3": "which parameters it takes, in order", "A4": "what {param} is when the caller leaves it out",
    "A5": "whether its signature has {feature}", "A6": "what return type its signature promises", "A7": "how {param} is annotated", "A8": "which decorators stand on it",
    "A9": "whether it is a coroutine", "A10": "what the code shows of the class it may belong to ({aspect})", "A11": "how many {count_of} its body holds {callee}", "A12": "what string literal number {n} says",
    "B1": "what line {line} reads, word for word", "B2": "what the condition of {construct} number {k} is", "B3": "what return statement number {k} hands back", "B4": "how the first line of its docstring reads",
    "B5": "which lines {construct} number {k} covers", "B6": "whether a {construct} stands anywhere in it", "C1": "what it is for, in one sentence", "C2": "what happens when {param} is {situation}",
    "C3": "how it gets from its inputs to its result", "C4": "whether it {property}", "C5": "which of the given summaries fits it", "C6": "which exceptions it raises itself", "C7": "what part the variable {var} plays, out of the given ones",
    "D1": "what it returns for {args}", "D2": "which input gives the result {output}", "D3": "what {var} holds after line {line} when it runs on {args}", "D4": "how often line {line} runs for {args}",
    "D5": "whether the branch at line {line} is taken for {args}", "D6": "how many rounds its loop makes for {args}", "D7": "which exception {args} ends in", "E1": "which check lets it leave early by {exit_kind}",
    "E2": "whether any of its code can never run", "E3": "what it can return, path by path", "F1": "where {var} gets its first value", "F2": "which of its parameters its result depends on", "F3": "whether it reads names from outside",
    "F4": "which names from outside it reads", "G1": "whether a default of it is mutable", "G2": "whether it swallows every exception", "G3": "whether a name of it hides a builtin {aspect}", "G4": "whether its first parameter is oddly named for a method",
    "H1": "what its docstring says", "H2": "whether the documented exceptions are those it raises", "H3": "what can be said of its docstring ({aspect})", "I1": "which function of the stack does what function {describe} does",
    "I2": "whether {decoy} is in the stack", "I3": "which of the given names belongs to function {describe}", "I4": "what holds of function {describe} of the stack ({inner})", "I5": "whether function {describe} is called {name}",
    "I6": "which two functions of the stack fit the description",
}
#: name: sentence around a clause.
STYLES: dict[str, str] = {
    "plain": "Tell me {x}.", "polite": "Could you please say {x}?", "short": "Quick one: {x}?", "docs": "For the manual I have to write down {x}.", "review": "Before this is merged, please clarify {x}.",
    "new": "I am new to this code and can't make out {x}. Can you?", "debug": "I am in the middle of a bug and must know {x}.", "exam": "From the source alone, determine {x}.", "chat": "hey, any idea {x}?",
    "ticket": "Open question: {x}?", "change": "I am about to change this, so I'd like to be sure {x}.", "aloud": "Right, so the one thing left to settle is {x}.",
}


def _filled(template: str, slot) -> Column:
    """A template with {slots} as a concatenation of its pieces."""
    pieces = re.split(r"\{(\w+)\}", template)
    return F.concat(*[F.lit(p) if i % 2 == 0 else F.coalesce(slot(p), F.lit("")) for i, p in enumerate(pieces)])


def style_of(key: Column) -> Column:
    """Number of the style of a key (a string)."""
    return F.pmod(F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long"), F.lit(len(STYLES)))


def phrased(facts: DataFrame, key: Column) -> DataFrame:
    """Adds clause, style and prompt to facts (intent, seed as JSON). key names a fact: the function, the intent and the seed."""
    value = lambda name: F.get_json_object("seed", f"$.{name}")
    clause, sentence, style = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string")
    for intent, card in CARDS.items():
        clause = F.when(F.col("intent") == intent, F.trim(_filled(card, value))).otherwise(clause)
    rows = facts.withColumn("clause", clause).withColumn("_style", style_of(key))
    for i, (name, template) in enumerate(STYLES.items()):
        sentence = F.when(F.col("_style") == i, _filled(template, lambda _: F.col("clause"))).otherwise(sentence)
        style = F.when(F.col("_style") == i, name).otherwise(style)
    return rows.withColumn("style", style).withColumn("prompt", F.when(F.col("clause").isNotNull(), sentence)).drop("_style")
