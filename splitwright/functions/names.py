"""Name keys: normalisation and the three suffix policies.

The policies differ on purpose (token list, number of tokens removed, result when nothing was
removed), so each has its own list and its own function.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Suffix tokens of the one-token policy.
ONE_TOKEN_SUFFIXES = (
    "hydrochloride", "dihydrochloride", "hydrobromide", "sulfate", "sulphate", "phosphate", "diphosphate",
    "bromide", "iodide", "chloride", "acetate", "tartrate", "citrate", "fumarate", "succinate", "maleate",
    "mesylate", "tosylate", "besylate", "lactate", "malate", "sodium", "potassium", "calcium", "magnesium",
    "lithium", "olamine", "pamoate", "stearate", "palmitate", "trihydrate", "dihydrate", "monohydrate",
    "hydrate", "edisylate", "gluconate", "glucuronate", "nitrate", "dimeglumine", "meglumine", "hyclate",
    "valerate", "propionate", "decanoate", "benzoate", "furoate", "enanthate",
)
# Suffix tokens of the two-token policy.
TWO_TOKEN_SUFFIXES = (
    "hydrochloride", "dihydrochloride", "hydrobromide", "sulfate", "sulphate", "phosphate", "diphosphate",
    "bromide", "iodide", "chloride", "acetate", "tartrate", "citrate", "fumarate", "succinate", "maleate",
    "mesylate", "tosylate", "besylate", "lactate", "malate", "sodium", "potassium", "calcium", "magnesium",
    "lithium", "olamine", "pamoate", "stearate", "palmitate", "trihydrate", "dihydrate", "monohydrate",
    "hydrate", "edisylate", "gluconate", "glucuronate", "nitrate", "dimeglumine", "meglumine", "hyclate",
    "valerate", "propionate", "decanoate", "benzoate", "furoate", "enanthate", "isethionate", "estolate",
    "glycinate", "succinylsulfate", "diethanolamine", "ethanolamine", "embonate", "edetate", "pivoxil",
    "fosamil",
)
# Suffix tokens of the repeated policy.
REPEATED_SUFFIXES = (
    "hydrochloride", "dihydrochloride", "hydrobromide", "sulfate", "sulphate", "phosphate", "diphosphate",
    "bromide", "iodide", "chloride", "acetate", "tartrate", "citrate", "fumarate", "succinate", "maleate",
    "mesylate", "tosylate", "besylate", "lactate", "malate", "sodium", "potassium", "calcium", "magnesium",
    "lithium", "olamine", "pamoate", "stearate", "palmitate", "trihydrate", "dihydrate", "monohydrate",
    "hydrate", "edisylate", "gluconate", "glucuronate", "nitrate", "dimeglumine", "meglumine", "hyclate",
    "valerate", "propionate", "decanoate", "benzoate", "furoate", "enanthate", "isethionate", "estolate",
    "glycinate", "succinylsulfate", "diethanolamine", "ethanolamine", "embonate", "edetate", "pivoxil",
    "fosamil", "complex",
)

# every character that counts as a blank in a Unicode text
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"

_BLANK_RUN = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


def trimmed(name: Column) -> Column:
    """Remove leading and trailing blanks of every kind (plain ``trim`` removes spaces only)."""
    return F.btrim(name, F.lit(BLANKS))


def name_key(name: Column) -> Column:
    """Trimmed lower-case name; null stays null and so never matches."""
    return F.lower(trimmed(name))


def single_blanks(name: Column) -> Column:
    """Trimmed text with one space between its tokens."""
    return F.regexp_replace(trimmed(name), _BLANK_RUN, " ")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once for all its uses in ``use``, by way of a one-element array."""
    return F.transform(F.array(value), use)[0]


def with_computed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is computed exactly once per row.

    Catalyst copies the expression of an ordinary column into every filter and join condition it
    infers from it, which multiplies the cost of a join key made by text functions. It does not look
    through a generator.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def _last_token(spaced: Column) -> Column:
    return F.substring_index(spaced, " ", -1)


def _alternatives(tokens: Sequence[str]) -> str:
    return "(?:" + "|".join(tokens) + ")"


def strip_one_suffix(key: Column, tokens: Sequence[str] = ONE_TOKEN_SUFFIXES) -> Column:
    """Key without its last token when that is a suffix token, otherwise null."""

    def shorter(spaced: Column) -> Column:
        last = _last_token(spaced)
        kept = F.length(spaced) - F.length(last) - 1
        return F.when(last.isin(*tokens) & (kept > 0), F.substring(spaced, F.lit(1), kept))

    return bound(single_blanks(key), shorter)


def strip_two_suffixes(key: Column, tokens: Sequence[str] = TWO_TOKEN_SUFFIXES) -> Column:
    """Key without one or two last suffix tokens, or without ``<suffix> complex``; else unchanged."""
    suffix = _alternatives(tokens)
    pattern = f"(?:(?: {suffix}){{1,2}}| {suffix} complex)$"

    def shorter(spaced: Column) -> Column:
        # most names end otherwise and skip the pattern
        ends = _last_token(spaced).isin(*tokens, "complex")
        return F.when(ends, bound(F.regexp_replace(spaced, pattern, ""), lambda bare: F.when(bare != spaced, bare)))

    return F.coalesce(bound(single_blanks(key), shorter), key)


def strip_all_suffixes(name: Column, tokens: Sequence[str] = REPEATED_SUFFIXES) -> Column:
    """Lower-case name without any trailing suffix tokens; the first token always stays."""
    pattern = f"(?: {_alternatives(tokens)})+$"

    def shorter(spaced: Column) -> Column:
        return F.when(_last_token(spaced).isin(*tokens), F.regexp_replace(spaced, pattern, "")).otherwise(spaced)

    return bound(single_blanks(F.lower(name)), shorter)


def spread_key(key: Column, row_id: Column, buckets: int = 4096) -> Column:
    """Join key of a left join in which null never matches.

    All null keys would hash to one task; give them many different values that no real key has.
    """
    filler = F.concat(F.lit("\u0000"), F.pmod(F.xxhash64(row_id), F.lit(buckets)).cast("string"))
    return F.coalesce(key, filler)
