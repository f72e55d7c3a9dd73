"""Fill-in-the-middle transformation by repeated captures.

A text is a sequence of units (lines). One full match of ``(unit)*`` keeps every repetition of its group, so
``match.ends(1)`` holds the number of units and every place where the text may be cut. Prefix and middle end at
two of them, drawn by a hash of the id; the parts are then put in the order that a model is trained on. A row
needs nothing but itself, so there is no shuffle.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splitwright.llm.text import arrow_map, documents

UNIT = r"[^\n]*\n|[^\n]+"
SEED = 7
#: Documents in a hundred that are transformed, and of these the ones whose suffix comes first.
RATE, SUFFIX_FIRST = 100, 50
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_SCHEMA = "doc_id long, text string, form string, n long, prefix_chars long, middle_chars long"


def draws(doc_id: Column, seed: int = SEED) -> list[Column]:
    """Four 32-bit draws of an id: the first digit groups of a hash of ``seed:id``; a null id has no digits."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"_h{k + 1}") for k in range(4)]


def cuts(match, h1: int, h2: int) -> tuple[int, int, int]:
    """Number of units and the ends of prefix and middle, from a full match of ``(unit)*``."""
    ends = match.ends(1)
    n = len(ends)
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    return n, ends[first - 1] if first else 0, ends[second - 1] if second else 0


def fill_in_middle(
    docs: DataFrame, unit: str = UNIT, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST
) -> DataFrame:
    """``doc_id, text, form, n, prefix_chars, middle_chars``: every document, transformed.

    ``unit`` must match every text as a whole when repeated. ``form`` is ``psm``, ``spm`` or ``plain``; a plain text
    is left as it is, its ``prefix_chars`` and ``middle_chars`` are null. Plain are empty texts, texts that hold
    a mark themselves, and those beyond ``rate``. Offsets are code points. A null text counts as empty, a null id as one without
    digits; repeated rows give repeated, equal results, and an empty table an empty one. Other columns are not
    read. Texts of any length are matched whole; a match takes about 150 bytes of memory for each unit.
    """

    def work():
        import regex

        units = regex.compile(f"({unit})*")

        def step(batch: pa.RecordBatch):
            texts, forms, numbers, prefixes, middles = [], [], [], [], []
            for text, h1, h2, h3, h4 in zip(*(batch[c].to_pylist() for c in ("text", "_h1", "_h2", "_h3", "_h4"))):
                text = text or ""
                n, a, b = cuts(units.fullmatch(text), h1, h2)
                numbers.append(n)
                if not text or h3 % 100 >= rate or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
                    forms.append("plain")
                    texts.append(text)
                    prefixes.append(None)
                    middles.append(None)
                    continue
                prefix, middle, suffix = PREFIX + text[:a], MIDDLE + text[a:b], SUFFIX + text[b:]
                spm = h4 % 100 < suffix_first
                forms.append("spm" if spm else "psm")
                texts.append(suffix + prefix + middle if spm else prefix + suffix + middle)
                prefixes.append(a)
                middles.append(b - a)
            longs = [pa.array(x, pa.int64()) for x in (numbers, prefixes, middles)]
            yield pa.record_batch(
                [batch["doc_id"], pa.array(texts, pa.string()), pa.array(forms, pa.string()), *longs],
                ["doc_id", "text", "form", "n", "prefix_chars", "middle_chars"],
            )

        return step

    rows = documents(docs)
    return arrow_map(rows.select("doc_id", "text", *draws(F.col("doc_id"), seed)), work, _SCHEMA)


def restored(text: Column, form: Column) -> Column:
    """The text before the transformation. No part holds a mark, so cutting at the marks finds the parts."""
    parts = F.split(text, "<[PSM]>")
    psm = F.concat(F.get(parts, 1), F.get(parts, 3), F.get(parts, 2))
    spm = F.concat(F.get(parts, 2), F.get(parts, 3), F.get(parts, 1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(text)


def middle_digest(docs: DataFrame) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256``."""
    out = fill_in_middle(docs)
    return out.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("text", 256).alias("output_sha256"),
        F.sha2(restored(F.col("text"), F.col("form")), 256).alias("restored_sha256"),
    )


SQL = f"""
with d as (select doc_id, coalesce(text, '') as t, sha256('{SEED}:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
u as (select *, regexp_extract_all(t, '[^\\n]*\\n|[^\\n]+') as units,
  cast('0x' || substr(h, 1, 8) as bigint) as h1, cast('0x' || substr(h, 9, 8) as bigint) as h2,
  cast('0x' || substr(h, 17, 8) as bigint) as h3, cast('0x' || substr(h, 25, 8) as bigint) as h4 from d),
c as (select *, len(units) as n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) as a,
  greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) as b from u),
p as (select doc_id, t, n, array_to_string(units[1:a], '') as prefix, array_to_string(units[a + 1:b], '') as middle,
  array_to_string(units[b + 1:n], '') as suffix,
  case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= {RATE} then 'plain'
    when h4 % 100 < {SUFFIX_FIRST} then 'spm' else 'psm' end as form from c)
select doc_id, n, form, case when form <> 'plain' then length(prefix) end as prefix_chars,
  case when form <> 'plain' then length(middle) end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256, sha256(t) as restored_sha256 from p
"""
