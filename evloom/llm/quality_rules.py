"""Line-first cleaning: rules per line, then a verdict on what is left.

A line with a word fails as punctuation (over PUNCT_PERCENT of its characters in words are ASCII
punctuation, or UNENDED_WORDS words or more hold no end of a sentence), as navigation
(at least NAV_MARKS separators, and one for every NAV_WORDS words or more) or as boilerplate (a stated
phrase, in a line of up to PHRASE_WORDS words). Failed lines go, and cleaned() gives the texts without
them; a document that loses over LOST_PERCENT of its words with them is rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import slices, texts_of
from .common import small_batches

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, lines_failed long, words_lost long"
)
PUNCT_PERCENT, UNENDED_WORDS, NAV_MARKS, NAV_WORDS, PHRASE_WORDS, LOST_PERCENT = 20, 8, 3, 4, 16, 50
#: The end of a sentence, closing marks behind it included.
ENDED = r"[.!?…。！？।؟][\"'”’»)\]]*([\x20\x09-\x0D]|$)"
NAV = "[|»›•·>]"
BOILERPLATE = (
    r"(?i)(all rights reserved|terms of (use|service)|privacy policy|cookie (policy|settings)|accept (all )?cookies|"
    r"enable javascript|click here|skip to content|sign in to continue|subscribe to our newsletter|share on (facebook|twitter)|"
    r"alle rechte vorbehalten|nutzungsbedingungen|datenschutz(erklärung|richtlinie)|cookie-(einstellungen|richtlinie)|cookies (akzeptieren|zulassen)|"
    r"hier klicken|zum inhalt springen|newsletter abonnieren|"
    r"tous droits réservés|conditions d.utilisation|politique de confidentialité|accepter (tous )?les cookies|cliquez ici|aller au contenu|abonnez-vous à|"
    r"todos los derechos reservados|términos de uso|política de privacidad|aceptar (todas )?las cookies|haga clic aquí|saltar al contenido|suscríbase a)"
)
_ENDED, _NAV, _BOILERPLATE = re.compile(ENDED), re.compile(NAV), re.compile(BOILERPLATE)
_NOT_PUNCT = re.compile(r"[^!-/:-@\[-`{-~]+")
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = b"#*$%&|<>"


def repeated_words(words: list[bytes]) -> int:
    """Words in three-word windows found twice or more in the text, the first one included."""
    if len(words) < 4:
        return 0
    index: dict[bytes, int] = {}
    ids = np.array([index.setdefault(w, len(index)) for w in words], np.int64)
    k = len(index)
    two = ids[:-2] * k + ids[1:-1]  # under 2**62 for 2**31 different words
    if k >= 1 << 20:
        two = np.unique(two, return_inverse=True)[1]
        k = max(k, 1)
    _, group, n = np.unique(two * k + ids[2:], return_inverse=True, return_counts=True)
    again = n[group] > 1
    found = np.zeros(len(words), bool)
    for j in range(3):
        found[j : j + len(again)] |= again
    return int(found.sum())


def line_fails(line: str, n_words: int) -> bool:
    chars = len(line) - sum(line.count(c) for c in " \t\n\x0b\x0c\r")
    punct = len(_NOT_PUNCT.sub("", line))
    if 100 * punct > PUNCT_PERCENT * chars:
        return True
    if n_words >= UNENDED_WORDS and not _ENDED.search(line):
        return True
    marks = len(_NAV.findall(line))
    return marks >= NAV_MARKS and marks * NAV_WORDS >= n_words or n_words <= PHRASE_WORDS and bool(_BOILERPLATE.search(line))


def clean(text: str) -> tuple[list[str], int, int, int]:
    """The lines that stay; failed lines, words lost with them, and lines equal to an earlier one."""
    stay, seen, failed, lost, dup = [], set(), 0, 0, 0
    for line in text.split("\n"):
        n = len(line.encode("utf-8", "surrogatepass").split())
        if not n:
            stay.append(line)
            continue
        dup += line in seen
        seen.add(line)
        if line_fails(line, n):
            failed, lost = failed + 1, lost + n
        else:
            stay.append(line)
    return stay, failed, lost, dup


def judge(text: str) -> tuple:
    """SCHEMA's values but the id, and the text without its failed lines."""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    chars = len(text) - (len(raw) - len(raw.translate(None, SPACES)))
    repeat = repeated_words(words)
    stay, failed, lost, dup = clean(text)
    bad = n < 50 or 100 * repeat > 50 * n
    return n, chars, len(raw) - len(raw.translate(None, SYMBOLS)), dup, repeat, bad, not bad and 100 * lost <= LOST_PERCENT * n, failed, lost, "\n".join(stay)


def quality_rules(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """SCHEMA's columns for every row of `docs`, rows in place.

    Null or empty text: no words, base_failed. Null id: passed on. Repeated rows: each judged. A share
    equal to a limit passes. Very long texts: whole. Empty table: no rows. Other columns, whatever
    their names, are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()] * 2
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for batch in batches:
            for part in slices(batch):
                found = list(zip(*[judge(t)[:-1] for t in texts_of(part)], strict=True))
                yield pa.record_batch([part.column("doc_id"), *[pa.array(c, k) for c, k in zip(found, kinds, strict=True)]], names)

    small_batches(docs.sparkSession)
    return docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text").mapInArrow(run, SCHEMA)


def cleaned(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """The rows of `docs` that quality_rules() keeps, their texts without the lines that fail (and
    n_chars, if there, to match); all other columns as they were, whatever their names.

    Nulls, ties, repeated rows, long texts and empty tables: as in quality_rules().
    """

    @F.arrow_udf("string")
    def without(text: pa.Array) -> pa.Array:
        found = [judge(t or "") for t in text.to_pylist()]
        return pa.array([x[-1] if x[6] else None for x in found], pa.string())

    names = docs.columns
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("d"), without(F.col(f"`{text_col}`")).alias("t")).where("t is not null")
    put = {text_col: F.col("t"), **({"n_chars": F.length("t").cast(docs.schema["n_chars"].dataType)} if "n_chars" in names else {})}
    return out.select(*[put.get(c, F.col(f"d.`{c}`")).alias(c) for c in names])


#: The same in DuckDB SQL.
ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
e AS (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM w),
g AS (SELECT doc_id, i, [x, lead(x) OVER o, lead(x, 2) OVER o] AS y, lead(x, 2) OVER o AS z FROM e WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, y) AS n FROM g WHERE z IS NOT NULL),
r AS (SELECT doc_id, count(DISTINCT j) AS n_repeat FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM c WHERE n > 1) GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS x, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM d),
f AS (SELECT doc_id, i, x, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS n,
  length(regexp_replace(x, '[\x20\x09-\x0D]', '', 'g')) AS chars, length(regexp_replace(x, '[^!-/:-@\[-`{{-~]+', '', 'g')) AS punct,
  len(regexp_extract_all(x, '{NAV}')) AS marks FROM l WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
v AS (SELECT *, row_number() OVER (PARTITION BY doc_id, x ORDER BY i) > 1 AS dup,
  (100 * punct > {PUNCT_PERCENT} * chars OR (n >= {UNENDED_WORDS} AND NOT regexp_matches(x, '{ENDED.replace("'", "''")}'))
   OR (marks >= {NAV_MARKS} AND marks * {NAV_WORDS} >= n) OR (n <= {PHRASE_WORDS} AND regexp_matches(x, '{BOILERPLATE}'))) AS bad FROM f),
s AS (SELECT doc_id, count_if(dup) AS n_dup, count_if(bad) AS failed, coalesce(sum(n) FILTER (bad), 0) AS lost FROM v GROUP BY doc_id),
b AS (SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(n_dup, 0) AS n_dup_lines,
  coalesce(n_repeat, 0) AS n_repeat_words, coalesce(failed, 0) AS lines_failed, CAST(coalesce(lost, 0) AS BIGINT) AS words_lost
  FROM d JOIN w USING (doc_id) LEFT JOIN r USING (doc_id) LEFT JOIN s USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * words_lost <= {LOST_PERCENT} * n_words AS kept, lines_failed, words_lost
FROM b"""
