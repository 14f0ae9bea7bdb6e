"""Words of a document, with markup taken off."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerline.functions.dates import col
from ledgerline.functions.references import unescape

# Words that do not count.
STOPWORDS = """a about above after again against all also am an and any are as at be because been before being below between both but by can could did do does
doing down during each few for from further had has have having he her here hers herself him himself his how i if in into is it its itself just may me
might more most must my myself no nor not of off on once only or other our ours ourselves out over own same shall she should so some such than that the
their theirs them themselves then there these they this those through to too under until up very was we were what when where which while who whom why will
with would you your yours yourself yourselves""".split()
# Blocks that hold no prose, what looks like markup, and the form of a word.
BLOCKS = ("script", "style", "ix:header", "head")
WORD = "([a-z][a-z'-]*[a-z]|[a-z])"


def without_markup(text: Column | str) -> Column:
    """Blocks that hold no prose and all tags become spaces, if the text looks like HTML."""
    t = F.coalesce(col(text), F.lit(""))
    looks = F.substring(t, 1, 20_000).rlike(r"(?i)<\s*(html|body|div|p|table|font)\b") | F.contains(F.substring(t, 1, 2_000), F.lit("<"))
    bare = F.regexp_replace(F.regexp_replace(t, rf"(?is)<({'|'.join(BLOCKS)})\b.*?</\1\s*>", " "), "<[^>]+>", " ")
    return F.when(looks, bare).otherwise(t)


def to_words(text: Column | str) -> Column:
    """Lower-case alphabetic words in order, stop words gone."""
    plain = F.replace(unescape(without_markup(text)), F.lit("\u00a0"), F.lit(" "))
    words = F.regexp_extract_all(F.lower(plain), F.lit(WORD), F.lit(1))
    return F.filter(words, lambda w: ~w.isin(STOPWORDS))
