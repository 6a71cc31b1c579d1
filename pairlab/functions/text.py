"""Tokenisers and n-gram expressions as native column expressions.

Everything here is a chain of built-in functions (regexp_replace, split, transform,
slice, array_join), so it runs inside whole-stage code generation on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal the scorer definitions for identical tokens)
# ---------------------------------------------------------------------------
# 13a tokeniser: punctuation class, written as Java-regex character ranges
# { to ~, [ to `, ! to &, ( to +, : to @, and / (the definition's range begins at the blank, but
# blanks around a blank are squeezed away again)
MTEVAL_PUNCT = r"([\{-~\[-`!-&\(-\+:-@/])"
# ([^0-9])([.,]) matches the first of a run of points and commas behind another character than a digit, and then
# every second one; this finds the same ones, but begins at points and commas only
MTEVAL_POINT = r"(?=[.,])(?:(?<=[^0-9.,])|([.,]))([.,])"
# Unicode white space but for single blanks, which stay as they are
_SPACE = "\\t-\\r \\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
MTEVAL_SPACE = f" [{_SPACE}]+|[{_SPACE.replace(' ', '')}][{_SPACE}]*"
# SGML entities replaced by the 13a tokeniser, in this order
MTEVAL_ENTITIES = [("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")]
# the international tokeniser also maps the apostrophe entity
INTL_ENTITIES = MTEVAL_ENTITIES + [("&apos;", "'")]
# hyphen characters (the Unicode Hyphen property, written out as a class)
HYPHENS = "\\-\u00ad\u058a\u1806\u2010\u2011\u2e17\u30fb\ufe63\uff0d\uff65"
# caption tokens removed after splitting
CAPTION_PUNCT = ["''", "'", "``", "`", "-LRB-", "-RRB-", "-LCB-", "-RCB-",
                 ".", "?", "!", ",", ":", "-", "--", "...", ";"]


def _lit_replace(s: Column, old: str, new: str) -> Column:
    return F.replace(s, F.lit(old), F.lit(new))


def normalize_mteval(col: Column, lowercase: bool = False) -> Column:
    """13a normalisation; returns the normalised string (tokens separated by one blank)."""
    s = _lit_replace(col, "<skipped>", "")
    s = _lit_replace(s, "-\n", "")
    s = _lit_replace(s, "\n", " ")
    for old, new in MTEVAL_ENTITIES:
        s = _lit_replace(s, old, new)
    s = F.concat(F.lit(" "), s, F.lit(" "))
    if lowercase:
        # the Perl scorer lower-cases ASCII only
        s = F.translate(s, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    s = F.regexp_replace(s, MTEVAL_PUNCT, " $1 ")
    s = F.regexp_replace(s, MTEVAL_POINT, "$1 $2 ")
    s = F.regexp_replace(s, r"([\.,])([^0-9])", " $1 $2")
    s = F.regexp_replace(s, r"([0-9])(-)", "$1 $2 ")
    s = F.regexp_replace(s, MTEVAL_SPACE, " ")
    return F.trim(s)


def mteval_text(col: Column, how: str = "mteval") -> Column:
    """13a tokens as one blank-separated string, case-folded as the scorer does:
    mteval = full Unicode lower-casing (Python scorer), perl = ASCII only, cased = none."""
    if how == "mteval":
        return F.lower(normalize_mteval(col))
    if how == "perl":
        return normalize_mteval(col, lowercase=True)
    if how == "cased":
        return normalize_mteval(col)
    raise ValueError(how)


def tokenize_mteval(col: Column, lowercase: bool = False) -> Column:
    """13a tokens as array<string>; an empty sentence is one empty token."""
    return F.split(normalize_mteval(col, lowercase), " ")


def tokenize_international(col: Column, preserve_case: bool = False,
                           split_non_ascii: bool = False) -> Column:
    """Unicode-aware tokeniser of the Perl scorer."""
    s = F.regexp_replace(col, "<skipped>", "")
    s = F.regexp_replace(s, "[" + HYPHENS + "]\u2028", "")
    s = F.regexp_replace(s, "\u2028", " ")
    for old, new in INTL_ENTITIES:
        s = _lit_replace(s, old, new)
    if not preserve_case:
        s = F.lower(s)
    if split_non_ascii:
        s = F.regexp_replace(s, r"([^\x00-\x7F])", " $1 ")
    s = F.regexp_replace(s, r"(\P{N})(\p{P})", "$1 $2 ")
    s = F.regexp_replace(s, r"(\p{P})(\P{N})", " $1 $2")
    s = F.regexp_replace(s, r"(\p{S})", " $1 ")
    s = F.regexp_replace(s, r"\p{Z}+", " ")
    s = F.regexp_replace(s, r"^\p{Z}+|\p{Z}+$", "")
    return F.split(s, " ")


# a word, or a single mark but for those of CAPTION_PUNCT (its longer ones can't be found as one token); letters of
# ASCII stand first, so that most characters are told by a range
CAPTION_TOKEN = r"[a-z0-9_\p{L}\p{N}]+|[^\p{L}\p{N}_\s'`.?!,:\-;]"


def tokenize_caption(col: Column) -> Column:
    """Lower-case, split words and single punctuation marks, drop punctuation tokens.

    Returns the tokens joined by one blank (the caption scorers split on whitespace)."""
    return F.array_join(F.regexp_extract_all(F.lower(col), F.lit(CAPTION_TOKEN), 0), " ")


def tokenize_words(col: Column) -> Column:
    """Lower-cased alphabetic tokens."""
    return F.regexp_extract_all(F.lower(col), F.lit(r"\p{L}+"), 0)


def lower_all(toks: Column) -> Column:
    return F.transform(toks, lambda t: F.lower(t))


def gram_pattern(n: int) -> str:
    """Zero-width match at every token start, capturing the next n tokens."""
    return r"(?:^| )(?=([^ ]+" + r"(?: [^ ]+)" * (n - 1) + "))"


def ngram_array(txt: Column, max_n: int, min_n: int = 1, empty_token: bool = True) -> Column:
    """All n-grams (n in [min_n, max_n]) of a normalised text as array<string>.

    ``txt`` holds tokens separated by single blanks, so a gram is the blank-joined
    tokens and its order is recoverable from the gram itself (``gram_order``).  The
    grams come from native regex scans (one per order), no per-gram lambda.  With
    ``empty_token`` an empty text is one empty token (split on one blank), else it has
    no tokens (whitespace split).
    """
    parts = []
    for n in range(min_n, max_n + 1):
        if n == 1:
            uni = F.split(txt, " ")
            if not empty_token:
                uni = F.when(txt == "", F.array().cast("array<string>")).otherwise(uni)
            parts.append(uni)
        else:
            parts.append(F.regexp_extract_all(txt, F.lit(gram_pattern(n)), 1))
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def gram_order(gram: Column) -> Column:
    """Number of tokens in a gram (tokens never contain a blank)."""
    return (F.length(gram) - F.length(F.replace(gram, F.lit(" "), F.lit(""))) + 1).cast("int")


def token_count(txt: Column, empty_token: bool = True) -> Column:
    n = (F.length(txt) - F.length(F.replace(txt, F.lit(" "), F.lit(""))) + 1).cast("int")
    return n if empty_token else F.when(txt == "", F.lit(0)).otherwise(n)


def ngrams(toks: Column, max_n: int, min_n: int = 1) -> Column:
    """n-grams of a token array as array<struct<n:int, gram:string>> (small arrays only;
    the scorers use ``ngram_array`` on normalised text)."""
    size = F.size(toks)

    def per_n(n: Column) -> Column:
        idx = F.when(size >= n, F.sequence(F.lit(0), size - n)).otherwise(
            F.array().cast("array<int>"))
        return F.transform(idx, lambda i: F.struct(
            n.cast("int").alias("n"), F.array_join(F.slice(toks, i + 1, n), " ").alias("gram")))

    return F.flatten(F.transform(F.sequence(F.lit(min_n), F.lit(max_n)), per_n))


def non_empty(toks: Column) -> Column:
    """Whitespace split semantics: drop empty tokens (``str.split()``)."""
    return F.filter(toks, lambda t: t != F.lit(""))
