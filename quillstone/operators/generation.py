"""Query texts from topics: contexts, styles, hints and surface noise, as Column expressions.

Every choice is a draw: a number in [0, 1) from the md5 of the seed, the row's keys and the purpose
of the choice, so that texts depend neither on partitions nor on each other. What the texts say comes
from tables of templates and slots that the caller gives.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How a label is named after a text; words with a shorter spelling; letters written out.
HINTS = (" (nach {0})", " - {0}", " (gemäß {0})", " unter Bezug auf {0}")
SHORTER = (("Österreich", "AT"), ("E-Mail", "Email"))
WRITTEN_OUT = (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss"))
LOWER_SHARE, TYPO_SHARE = 0.7, 0.5
LONG_WORD = r"^\p{L}{6,}$"


def draw(seed: int, key: Column, purpose: str) -> Column:
    """A number in [0, 1) with 52 random bits."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), key, F.lit(purpose))), 1, 13), 16, 10).cast("long") / F.lit(2.0**52)


def pick(values: Column, at: Column) -> Column:
    """The element of a non-empty array that the draw `at` falls on."""
    return F.get(values, F.floor(at * F.size(values)).cast("int"))


def one_blank(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def fill(template: Column, slots: Mapping[str, Sequence[str]], fixed: Mapping[str, Column], seed: int, key: Column) -> Column:
    """The template with a chosen value in each slot (the same wherever the slot stands), single blanks."""
    for name in slots:
        chosen = pick(F.array(*map(F.lit, slots[name])), draw(seed, key, f"slot {name}"))
        template = F.replace(template, F.lit("{%s}" % name), chosen)
    for name, value in fixed.items():
        template = F.replace(template, F.lit("{%s}" % name), value)
    return one_blank(template)


def hint(text: Column, label: Column, at: Column) -> Column:
    return F.concat(text, F.replace(pick(F.array(*map(F.lit, HINTS)), at), F.lit("{0}"), label))


def typo(text: Column, seed: int, key: Column) -> Column:
    """One edit in one word of six letters or more: of the two letters before a chosen inner place, the second
    is left out, written twice, or put before the first."""
    words = F.split(text, " ")
    at = pick(F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.get(words, i).rlike(LONG_WORD)), draw(seed, key, "word"))
    word = F.get(words, at)
    place = (F.floor(draw(seed, key, "letter") * (F.length(word) - 2)) + 1).cast("int")  # letters before the pair's second
    letter = lambda i: F.substr(word, i, F.lit(1))
    x, y = letter(place), letter(place + 1)
    edits = F.array(x, F.concat(x, y, y), F.concat(y, x))
    edited = F.concat(F.substr(word, F.lit(1), place - 1), pick(edits, draw(seed, key, "edit")), F.substr(word, place + 2))
    changed = F.array_join(F.transform(words, lambda w, i: F.when(i == at, edited).otherwise(w)), " ")
    return F.when(at.isNull(), text).otherwise(changed)


def noise(text: Column, share: float, seed: int, key: Column) -> Column:
    """With probability `share` one of six changes: either shorter spelling, letters written out, the question mark
    left out or added, lower case (in LOWER_SHARE of its cases) or a typo (in TYPO_SHARE)."""
    written = text
    for a, b in WRITTEN_OUT:
        written = F.replace(written, F.lit(a), F.lit(b))
    gate = draw(seed, key, "gate")
    changes = F.array(
        *[F.replace(text, F.lit(a), F.lit(b)) for a, b in SHORTER],
        written,
        F.when(text.endswith("?"), F.regexp_replace(text, r"\?+$", "")).otherwise(F.concat(text, F.lit("?"))),
        F.when(gate < LOWER_SHARE, F.lower(text)).otherwise(text),
        F.when(gate < TYPO_SHARE, typo(text, seed, key)).otherwise(text),
    )
    return F.when(draw(seed, key, "noise") < share, one_blank(pick(changes, draw(seed, key, "change")))).otherwise(text)


def queries(
    topics: DataFrame,
    styles: Mapping[str, Sequence[str]],
    slots: Mapping[str, Sequence[str]],
    seed: int = 19,
    variants: int = 2,
    hint_share: float = 0.15,
    noise_share: float = 0.2,
    contexts: Sequence[str] = ("",),
    scenarios: Sequence[str] = ("",),
    facets: Sequence[str] = ("",),
) -> DataFrame:
    """(query_id, topic_id, query_text, consensus_law, style, issue): `variants` texts in each style for each topic
    (topic_id, label, issue). Templates may use {issue}, {context}, {scenario}, {facet} and the slots; contexts, scenarios
    and facets are what the like-named places are filled from. Rows with a null topic_id or issue give none."""
    t = topics.where("topic_id IS NOT NULL AND issue IS NOT NULL").select(F.col("topic_id").cast("string").alias("topic_id"), "label", "issue")
    forms = F.array(*[F.struct(F.lit(s).alias("style"), F.lit(v).alias("v"), F.array(*map(F.lit, styles[s])).alias("templates")) for s in styles for v in range(1, variants + 1)])
    t = t.withColumn("form", F.explode(forms)).select("*", "form.*")
    key = F.concat_ws(":", "topic_id", "style", F.col("v").cast("string"))
    more = {"context": contexts, "scenario": scenarios, "facet": facets}
    text = fill(pick(F.col("templates"), draw(seed, key, "template")), {**slots, **more}, {"issue": F.col("issue")}, seed, key)
    t = t.withColumn("query_text", text)
    hinted = F.coalesce(F.col("label") != "", F.lit(False)) & (draw(seed, key, "hint") < hint_share)
    t = t.withColumn("query_text", F.when(hinted, hint(F.col("query_text"), F.col("label"), draw(seed, key, "form of hint"))).otherwise(F.col("query_text")))
    name = F.concat("topic_id", F.lit("_"), "style", F.lit("_v"), F.lpad(F.col("v").cast("string"), 2, "0"))
    return t.select(name.alias("query_id"), "topic_id", noise(F.col("query_text"), noise_share, seed, key).alias("query_text"), F.col("label").alias("consensus_law"), "style", "issue")
