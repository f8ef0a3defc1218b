"""Text expressions: Unicode forms, slugs, identifiers, terms, model-input templates."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F, types as T

# The English stop-word list of the keyword index.
STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it
its itself they them their theirs themselves what which who whom this that these those am is are was were be been
being have has had having do does did doing a an the and but if or because as until while of at by for with about
against between into through during before after above below to from up down in out on off over under again further
then once here there when where why how all any both each few more most other some such no nor not only own same so
than too very s t can will just don should now
""".split()

# What counts as an identifier in a question, and how many are used. A token is a letter or digit and the
# [\w.-/] characters after it; it counts if it has a digit, or is two and more capitals followed by word characters.
# Both tests are part of the pattern, so ordinary words never become rows of an array.
IDENTIFIER = (r"(?<![\w.\-/])[_.\-/]*+((?=[\w.\-/]*[0-9])[A-Za-z0-9][\w.\-/]*|[A-Z]{2,}[\w\-]*(?![\w.\-/]))")
MAX_IDENTIFIERS = 12
PIECE_BYTES = 1_000_000  # of text that a kernel turns into Python objects at a time


@F.pandas_udf(T.StringType())
def nfc(values: pd.Series) -> pd.Series:
    """Unicode NFC form."""
    return values.map(lambda v: unicodedata.normalize("NFC", v), na_action="ignore")


@F.pandas_udf(T.StringType())
def nfkd(values: pd.Series) -> pd.Series:
    """Unicode NFKD form."""
    return values.map(lambda v: unicodedata.normalize("NFKD", v), na_action="ignore")


def slug(value: Column) -> Column:
    """Name-safe form: lower case, runs of other characters become '-', at most 60 characters, never empty."""
    dashed = F.regexp_replace(nfkd(F.lower(value)), "[^a-z0-9]+", "-")
    cut = F.substring(F.regexp_replace(dashed, "^-+|-+$", ""), 1, 60)
    return F.when(cut == "", F.lit("empty")).otherwise(cut)


def identifiers(text: Column) -> Column:
    """Identifier-like tokens (a digit, or two and more capitals) in first-seen order, at most twelve."""
    found = F.regexp_extract_all(text, F.lit(IDENTIFIER), F.lit(1))
    return F.slice(F.array_distinct(found), 1, MAX_IDENTIFIERS)


def terms(text: Column) -> Column:
    """Lower-case runs of letters, digits and underscore, in order (stop words included, so positions stay true)."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def is_stop_word(term: Column) -> Column:
    return term.isin(STOP_WORDS)


def index_terms(text: Column) -> Column:
    """Distinct indexable terms of a text: terms without stop words."""
    return F.array_distinct(F.filter(terms(text), lambda t: ~is_stop_word(t)))


def document_input(template: str, title: Column, content: Column) -> Column:
    """Model input of a passage. The title goes in first, then the content, as plain text replacement."""
    return F.replace(F.replace(F.lit(template), F.lit("{title}"), title), F.lit("{content}"), content)


def query_input(prompt: str, text: Column) -> Column:
    """Model input of a question."""
    return F.concat(F.lit(prompt), text)


def contextual_title(filename: Column, section: Column, page: Column) -> Column:
    """Place of a passage in its document: file › section · p. N, with '|' made '/', at most 300 characters."""
    with_section = F.when(F.length(section) > 0, F.concat(F.lit(" › "), section)).otherwise("")
    with_page = F.when(page > 0, F.concat(F.lit(" · p. "), page.cast("string"))).otherwise("")
    return F.substring(F.translate(F.concat(filename, with_section, with_page), "|", "/"), 1, 300)


def pieces(batch: pa.RecordBatch, text: str, size: int | None = None) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in slices of about ``size`` bytes of text, so a kernel's memory does not follow the batch."""
    lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = (np.cumsum(lengths) - lengths) // (size or PIECE_BYTES)
    starts = np.flatnonzero(np.diff(group, prepend=-1)).tolist()
    for start, end in zip(starts, [*starts[1:], len(lengths)]):
        yield batch.slice(start, end - start)
