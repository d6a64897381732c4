"""Text functions as column expressions; null in, null out unless stated."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The characters that Unicode-aware strip removes.
WHITESPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + "    　"
STRIP_PATTERN = f"^[{WHITESPACE}]+|[{WHITESPACE}]+$"
# Fixed value: the pre-token pattern that byte-level vocabularies were made with.
BYTE_BPE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
FORMS = ("NFC", "NFD", "NFKC", "NFKD")


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, STRIP_PATTERN, "")


def normalize_unicode(text: Column, form: str = "NFC") -> Column:
    if form not in FORMS:
        raise ValueError(f"form must be one of {FORMS}")

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: unicodedata.normalize(form, t), na_action="ignore")

    return run(text)


def strip_accents(text: Column) -> Column:
    """Decomposed, without combining marks."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn"), na_action="ignore")

    return run(text)


def byte_count(text: Column) -> Column:
    """Length of the text in UTF-8, as bigint."""
    return F.octet_length(text.cast("string")).cast("bigint")


def word_count(text: Column) -> Column:
    """Words and punctuation marks: a tokenizer that needs no vocabulary."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]")).cast("bigint")


def token_count(text: Column, tokenizer: Callable[[], Callable[[list[str]], list[int]]]) -> Column:
    """Tokens of a text as bigint, null for null; ``tokenizer`` is called once per worker and gives a function from texts to counts."""

    @F.pandas_udf("bigint")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = tokenizer()
        for batch in batches:
            own = batch.dropna()
            yield pd.Series(count(own.tolist()), index=own.index, dtype="Int64").reindex(batch.index)

    return run(text)


def byte_pairs(path: str, pattern: str = BYTE_BPE_PATTERN) -> Callable[[], Callable[[list[str]], list[int]]]:
    """For :func:`token_count`: a byte-level vocabulary file (a base64 token and its rank in each line) that every executor can read."""

    def load() -> Callable[[list[str]], list[int]]:
        import base64

        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}
        encoding = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(ids) for ids in encoding.encode_ordinary_batch(texts, num_threads=1)]

    return load


def underscored(text: Column) -> Column:
    return F.regexp_replace(text, f"[{WHITESPACE}]+", "_")


def classifier_text(text: Column, lower: bool = True, newline: str = " __newline__ ", split_punctuation: bool = True) -> Column:
    """As a bag-of-words classifier reads it: newlines named, ends stripped, lower case, punctuation on its own.

    Fixed values: the name of a newline and the punctuation marks.
    """
    out = F.replace(strip(text), F.lit("\n"), F.lit(newline))
    out = F.lower(out) if lower else out
    out = strip(out)
    return F.regexp_replace(out, r"([.!?,'/()])", " $1 ") if split_punctuation else out


def canonical_label(label: Column) -> Column:
    return F.replace(F.lower(label.cast("string")), F.lit(" "), F.lit("_"))


# Typographic punctuation and what a language model reads instead.
LM_PUNCTUATION = {
    "，": ",", "。": ".", "、": ",", "„": '"', "”": '"', "“": '"', "«": '"', "»": '"', "１": '"', "」": '"', "「": '"', "《": '"', "》": '"',
    "´": "'", "∶": ":", "：": ":", "？": "?", "！": "!", "（": "(", "）": ")", "；": ";", "–": "-", "—": " - ", "．": ". ", "～": "~",
    "’": "'", "…": "...", "━": "-", "〈": "<", "〉": ">", "【": "[", "】": "]", "％": "%", "►": "-",
}


def language_model_text(text: Column, lower: bool = True, accents: bool = True, numbers: bool = True, punctuation: bool = True) -> Column:
    """Stripped; lower case, accents gone, digits 0 and punctuation plain as asked; control characters gone."""
    out = strip(text)
    out = F.lower(out) if lower else out
    out = strip_accents(out) if accents else out
    out = F.regexp_replace(out, r"(?U)\d", "0") if numbers else out
    if punctuation:
        single = {a: b for a, b in LM_PUNCTUATION.items() if len(b) == 1}
        out = F.translate(out, "".join(single), "".join(single.values()))
        for mark, plain in LM_PUNCTUATION.items():
            if len(plain) > 1:
                out = F.replace(out, F.lit(mark), F.lit(plain))
    return F.regexp_replace(out, r"[\x00-\x1f\x7f-\x9f]", "")


def shared_prefix(a: Column, b: Column, strip_whitespace: bool = True) -> Column:
    """The longest common prefix; null if either text is null."""
    a, b = (strip(a), strip(b)) if strip_whitespace else (a, b)
    size = F.when(a.isNotNull() & b.isNotNull(), F.least(F.length(a), F.length(b)))
    differs = F.array_position(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x.eqNullSafe(y)), F.lit(False))
    end = F.when(differs == 0, size).otherwise(F.least(differs - 1, size))
    return F.when(size == 0, F.lit("")).otherwise(F.substring(a, F.lit(1), end.cast("int")))


def with_shared_prefix(df: DataFrame, a: str, b: str, prefix: str, suffix_a: str | None = None, suffix_b: str | None = None, strip_whitespace: bool = True) -> DataFrame:
    """``prefix``, and what follows it in either text where a suffix column is named; null if either text is null."""
    left, right = (strip(F.col(c)) if strip_whitespace else F.col(c) for c in (a, b))
    new = {prefix: shared_prefix(F.col(a), F.col(b), strip_whitespace)}
    for name, text in ((suffix_a, left), (suffix_b, right)):
        if name:
            new[name] = F.substring(text, F.length(new[prefix]) + 1, F.length(text))
    return df.withColumns(new)


def truncated(text: Column, length: int = 250) -> Column:
    return F.left(text, F.lit(length))


_CHAIN = {"strip": strip, "lower": F.lower, "upper": F.upper, "title": F.initcap, "lstrip": lambda c: F.regexp_replace(c, f"^[{WHITESPACE}]+", ""), "rstrip": lambda c: F.regexp_replace(c, f"[{WHITESPACE}]+$", "")}


def chained(text: Column, names: Iterable[str]) -> Column:
    """Named functions one after the other; an unknown name is a ValueError."""
    for name in names:
        if name not in _CHAIN:
            raise ValueError(f"unknown normalisation {name!r}; known: {sorted(_CHAIN)}")
        text = _CHAIN[name](text)
    return text
