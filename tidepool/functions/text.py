"""Text functions as columns: sanitising, stop words, tokens, normal form, estimates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words without meaning of their own in a question.
STOP_WORDS = """
a an the is are was were am be been being do did does have has had will would could should can may might shall must
i me my mine we us our ours you your yours he him his she her hers it its they them their theirs
this that these those and or but nor so if then than how what when where which who whom why
in on at to for of with from by about into up out off over under between through during before after
not no very just also too only there here as
""".split()


def sanitize(query: Column) -> Column:
    """Query punctuation and hyphens become blanks, runs of blanks one."""
    return F.trim(F.regexp_replace(F.regexp_replace(query, r"""[*"():^{}+~?,.!;'\[\]\-]""", " "), r"\s+", " "))


def strip_stop_words(query: Column) -> Column:
    """Without stop words; the query itself where nothing else is in it."""
    words = F.split(query, " ")
    left = F.array_join(F.filter(words, lambda w: ~F.array_contains(F.lit(STOP_WORDS), F.lower(w)) & (w != "")), " ")
    return F.when(left == "", query).otherwise(left)


def tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), " "), lambda w: w != "")


def normalize(text: Column) -> Column:
    """Lower case; all but ASCII letters and digits one blank."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def estimated_tokens(text: Column, per_byte: float = 0.25) -> Column:
    return F.ceil(F.octet_length(text) * F.lit(per_byte)).cast("long")


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def for_embedding(text: Column, most_bytes: int = 32_000) -> Column:
    """At most so many bytes of UTF-8, cut before the last blank where there is one, else before a character."""
    # whole characters within so many bytes, and the one that is cut through
    n = F.length(F.substring(F.encode(text, "UTF-8"), 1, most_bytes).cast("string"))
    full = F.substring(text, F.lit(1), n)
    cut = F.when(F.octet_length(full) <= most_bytes, full).otherwise(F.substring(text, F.lit(1), n - 1))
    blank = F.regexp_replace(cut, r"\s\S*$", "")
    return F.when(F.octet_length(text) <= most_bytes, text).otherwise(F.when(blank == "", cut).otherwise(blank))


def dated(text: Column, date: Column) -> Column:
    """The text behind its session's date, if it has one."""
    return F.when(date != "", F.concat(F.lit("[Date: "), date, F.lit("] "), text)).otherwise(text)
