"""Text column functions. Every one is a composition of JVM-side built-ins."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce
from operator import or_

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as Unicode-aware matching sees it, and word characters.
WHITE = r"\p{IsWhite_Space}\x1c-\x1f"
WORD = r"\p{L}\p{N}_"

TAG = r"<[^>\n]*>"
LINK = rf"(?:http|www)[^{WHITE}]+"
# Anchored at the start of a run of non-blank characters, so each run is tried once and
# long unbroken runs stay linear.
MAIL = rf"(?<![^{WHITE}])[^{WHITE}][^{WHITE}@]*+@[^{WHITE}]+"
# One class, without the digits among the word characters; what is most frequent comes first.
NOT_PLAIN = rf"[^a-z \p{{L}}\p{{Nl}}\p{{No}}_{WHITE}]"
# Every run of white space but the single blank, which is what nearly all of them are.
BLANKS = rf"[{WHITE}&&[^ ]][{WHITE}]*| [{WHITE}]+"
TERM = rf"[{WORD}]{{2,}}"

# Contractions that split into two tokens.
CONTRACTIONS = (
    ("can", "not"),
    ("gim", "me"),
    ("gon", "na"),
    ("got", "ta"),
    ("lem", "me"),
    ("wan", "na"),
)
_JOINED = tuple(a + b for a, b in CONTRACTIONS)
_SPLIT_POINT = r"(?U)\b(?:" + "|".join(f"{a}(?={b}\\b)" for a, b in CONTRACTIONS) + ")"

# Languages with a stop-word list.
STOP_WORD_LANGUAGES = (
    "danish",
    "dutch",
    "english",
    "finnish",
    "french",
    "german",
    "hungarian",
    "italian",
    "norwegian",
    "portuguese",
    "russian",
    "spanish",
    "swedish",
    "turkish",
)

# The short list used when no language list is wanted.
BASIC_STOP_WORDS = (
    "a",
    "an",
    "the",
    "and",
    "or",
    "but",
    "is",
    "are",
    "was",
    "were",
    "to",
    "of",
    "in",
    "for",
    "with",
)

#: The English stop words that Spark ships, in alphabetical order.
ENGLISH_STOP_WORDS = tuple(
    """
    a about above after again against all am an and any are aren't as at be because been before
    being below between both but by can can't cannot could couldn't did didn't do does doesn't
    doing don don't down during each few for from further had hadn't has hasn't have haven't
    having he he'd he'll he's her here here's hers herself him himself his how how's i i'd i'll
    i'm i've if in into is isn't it it's its itself just let's me more most mustn't my myself no
    nor not now of off on once only or other ought our ours ourselves out over own s same shan't
    she she'd she'll she's should shouldn't so some such t than that that's the their theirs
    them themselves then there there's these they they'd they'll they're they've this those
    through to too under until up very was wasn't we we'd we'll we're we've were weren't what
    what's when when's where where's which while who who's whom why why's will with won't would
    wouldn't you you'd you'll you're you've your yours yourself yourselves
    """.split()
)

# Length classes, upper bound exclusive.
LENGTH_CLASSES = (("empty", 1), ("very_short", 50), ("short", 200), ("medium", 500))
LONGEST_CLASS = "long"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _replace(c: Column, pattern: str, by: str, *hints: str) -> Column:
    """``pattern`` replaced in texts that hold one of the ``hints``, without which none matches.

    Looking for a fixed string takes a fraction of the time of trying a pattern everywhere.
    """

    def replaced(t: Column) -> Column:
        hinted = reduce(or_, [F.contains(t, F.lit(h)) for h in hints])
        return F.when(hinted, F.regexp_replace(t, pattern, by)).otherwise(t)

    # Bound to a name first: the text is worked out once.
    return F.get(F.transform(F.array(c), replaced), F.lit(0))


def squeeze(c: Column | str) -> Column:
    """Collapse runs of white space to one blank and trim, keeping case."""
    return F.trim(F.regexp_replace(_col(c), BLANKS, " "))


def _plain(c: Column) -> Column:
    return squeeze(F.regexp_replace(c, NOT_PLAIN, ""))


def clean_text(c: Column | str) -> Column:
    """Lower-case; drop tags, links, mail addresses, punctuation and digits; squeeze.

    Null gives the empty string.
    """
    c = F.lower(F.coalesce(_col(c), F.lit("")))
    for pattern, hints in ((TAG, ("<",)), (LINK, ("http", "www")), (MAIL, ("@",))):
        c = _replace(c, pattern, "", *hints)
    return _plain(c)


def basic_clean(c: Column | str) -> Column:
    """Lower-case, drop punctuation and digits, squeeze; tags and links are kept."""
    return _plain(F.lower(F.coalesce(_col(c), F.lit(""))))


def words(c: Column | str) -> Column:
    """White-space words of any text; null and blank give an empty array."""
    return _split(squeeze(F.coalesce(_col(c), F.lit(""))))


def _split(line: Column) -> Column:
    # One plain blank between words: the split needs no regular expression.
    return F.array_remove(F.split(line, " "), "")


def tokenize(c: Column | str, squeezed: bool = False) -> Column:
    """Word tokens of cleaned text, with joined contractions split.

    In text that is ``squeezed``, as ``clean_text`` gives it, blanks need no second look.
    """
    line = _replace(_col(c), _SPLIT_POINT, "$0 ", *_JOINED)
    return _split(F.coalesce(line, F.lit(""))) if squeezed else words(line)


def terms(c: Column | str) -> Column:
    """Lower-case word runs of two or more characters, the unit of the feature tables."""
    return F.regexp_extract_all(F.lower(F.coalesce(_col(c), F.lit(""))), F.lit(TERM), F.lit(0))


def stop_words(language: str = "english") -> tuple[str, ...]:
    """The stop-word list of a language; ``basic`` is the short built-in list."""
    if language == "basic":
        return BASIC_STOP_WORDS
    language = "english" if language == "en" else language
    if language == "english":
        return ENGLISH_STOP_WORDS
    if language not in STOP_WORD_LANGUAGES:
        raise ValueError(f"no stop words for language {language!r}")
    return tuple(sorted(set(StopWordsRemover.loadDefaultStopWords(language))))


def chosen_stops(stops: Iterable[str] | None) -> list[str]:
    """The given words, or the English list where none are given."""
    return list(stop_words() if stops is None else stops)


def remove_stopwords(tokens: Column | str, stops: Iterable[str], exact: bool = False) -> Column:
    """Drop stop words, comparing the lower-cased token unless ``exact``."""
    stops = list(stops)
    if not stops:
        return _col(tokens)
    return F.filter(
        _col(tokens), lambda t: ~(t if exact else F.lower(t)).isin(stops)
    )


def lemmatize(tokens: Column | str, lemmas: Mapping[str, str]) -> Column:
    """Replace tokens by their lemma; the table becomes one literal of the plan.

    ``operators.tokens.lemmatize_tokens`` joins a lemma frame instead.
    """
    if not lemmas:
        return _col(tokens)
    table = F.map_from_arrays(F.lit(list(lemmas)), F.lit(list(lemmas.values())))
    return F.transform(_col(tokens), lambda t: F.coalesce(F.try_element_at(table, t), t))


def drop_short(tokens: Column | str, shortest: int = 3) -> Column:
    """Keep tokens of at least ``shortest`` characters."""
    return F.filter(_col(tokens), lambda t: F.length(t) >= shortest)


def normalize_text(
    c: Column | str,
    stops: Iterable[str],
    lemmas: Mapping[str, str] | None = None,
    shortest: int = 3,
    squeezed: bool = False,
) -> Column:
    """Tokenise, drop stop words (exact), lemmatise, drop short tokens, join."""
    tokens = remove_stopwords(tokenize(c, squeezed), stops, exact=True)
    if lemmas:
        tokens = lemmatize(tokens, lemmas)
    return F.array_join(drop_short(tokens, shortest), " ")


def text_length(c: Column | str) -> Column:
    return F.length(F.coalesce(_col(c), F.lit("")))


def _letters(squeezed: Column) -> Column:
    return F.length(F.replace(squeezed, F.lit(" "), F.lit("")))


def word_count(c: Column | str) -> Column:
    """Number of white-space words, from lengths alone: blanks between words plus one."""
    line = squeeze(F.coalesce(_col(c), F.lit("")))
    return F.when(F.length(line) > 0, F.length(line) - _letters(line) + 1).otherwise(0)


def avg_word_length(c: Column | str) -> Column:
    """Mean word length, 0 for text without words."""
    line = squeeze(F.coalesce(_col(c), F.lit("")))
    letters = _letters(line)
    words_in_line = F.length(line) - letters + 1
    return F.when(F.length(line) > 0, letters / words_in_line).otherwise(F.lit(0.0))


def length_category(length: Column | str) -> Column:
    """Name the length class of a text length."""
    length = _col(length)
    out = None
    for name, bound in LENGTH_CLASSES:
        out = F.when(length < bound, name) if out is None else out.when(length < bound, name)
    return out.otherwise(LONGEST_CLASS)


def topic_label(topic_id: Column | str, top_words: Column | str) -> Column:
    """``Topic i: w1, w2, w3``; without words just ``Topic i``."""
    head = F.concat(F.lit("Topic "), _col(topic_id).cast("int").cast("string"))
    lead = F.array_join(F.slice(_col(top_words), 1, 3), ", ")
    return F.when(F.size(_col(top_words)) > 0, F.concat(head, F.lit(": "), lead)).otherwise(head)


def json_object_text(c: Column | str) -> Column:
    """The stretch from the first ``{`` to the last ``}``; null when there is none."""
    found = F.regexp_extract(_col(c), r"(?s)\{.*\}", 0)
    return F.when(F.length(found) > 0, found)


def parse_json_reply(c: Column | str, missing: str, broken: str) -> Column:
    """Struct ``(body, error)``: the recovered JSON text or the reason there is none."""
    body = json_object_text(c)
    valid = F.try_parse_json(body).isNotNull()
    return F.struct(
        F.when(valid, body).alias("body"),
        F.when(body.isNull(), missing).when(~valid, broken).alias("error"),
    )


def hash_embedding(c: Column | str) -> Column:
    """Five-value deterministic vector of a text.

    Length over 1000 capped at 1; the character-code sum of the first 100 characters
    modulo 1000, over 1000; three values in [0, 1) derived from that sum.
    """
    c = _col(c)
    chars = F.split(F.substring(c, 1, 100), "")
    code = F.aggregate(chars, F.lit(0), lambda acc, ch: acc + F.ascii(ch)) % 1000
    # Multiplier, increments and modulus of the derived dimensions.
    def vector(code: Column) -> Column:
        derived = [((code * 7919 + plus) % 10007) / F.lit(10007.0) for plus in (101, 211, 307)]
        size = F.least(F.lit(1.0), F.length(c) / F.lit(1000.0))
        return F.array(size, code / F.lit(1000.0), *derived)

    # The one-element array lets the character sum be worked out once.
    return F.transform(F.array(code), vector)[0]
