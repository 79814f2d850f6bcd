"""Names of a glossary: readings per character, what is a reading, a meaning in English or a romanisation, and mending.

Rules are columns over (term, right, kind). A character's readings come from a table that is a parameter; it is bounded by
the script, and broadcast. Readings are arrays per character, so a name is aligned with them element by element.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import islice, product

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import HAN, trim_unicode
from quillspark.operators.pair_gates import looks_western

#: More characters than any script has.
MOST_CHARACTERS = 120_000
KINDS = ("person", "place", "sect")

# Loanwords in use, function words of English, tone marks of the romanisation, sounds of a syllable without marks.
LOANWORDS = "anime app boss buff bug cosplay debuff dwarf elf goblin guild idol instance karate kimono mod ninja npc ogre orc respawn sake slime troll virus vodka whisky zombie".split()
FUNCTION_WORDS = "and at by for from in into of on or over the under with".split()
TONE_MARKS = "[āēīōūǖǎěǐǒǔǚǘǜǹ]"
LATIN_NAME = r"^[A-Z][A-Za-z]*(?:[ .'\-][A-Za-z]+){0,2}$"
ONSETS = "b c ch d g gh gi h k kh l m n ng ngh nh p ph qu r s t th tr v x".split()
RHYMES = """a ac ach ai am an ang anh ao ap at au ay e ec ech em en eng enh eo ep et eu i ia ich iec iem ien ieng iep iet ieu in inh ip it iu
o oa oac oach oai oam oan oang oanh oao oap oat oay oc oe oen oeo oet oi om on ong ooc oong op ot u ua uac uach uai uan uang uanh uao uat uay uc ue uech uen
uenh uet ui um un ung uoc uoi uom uon uong uop uot uou up ut uu uy uya uych uyen uyet uynh uyp uyt uyu y yen yet yeu ynh""".split()

SYLLABLE = f"^(?:{'|'.join(sorted(ONSETS, key=lambda x: (-len(x), x)))})?(?:{'|'.join(sorted(RHYMES, key=lambda x: (-len(x), x)))})$"


def readings_of(table: DataFrame) -> Callable[[Column], Column]:
    """A function from a term's column to array<array<string>>: the readings of each character, empty for unknown ones.

    table: char, readings array<string> in order of preference; a character given twice keeps the first in code-point order
    of its readings. Raises beyond MOST_CHARACTERS. Null terms give null.
    """
    rows = table.groupBy("char").agg(F.min("readings").alias("readings")).limit(MOST_CHARACTERS + 1).collect()
    if len(rows) > MOST_CHARACTERS:
        raise ValueError(f"more than {MOST_CHARACTERS} characters")
    shared = table.sparkSession.sparkContext.broadcast({r["char"]: [x for x in r["readings"] or [] if x] for r in rows})

    def run(terms: pa.Array) -> pa.Array:
        known = shared.value
        return pa.array([None if t is None else [known.get(c, []) for c in t] for t in terms.to_pylist()], pa.list_(pa.list_(pa.string())))

    return F.arrow_udf(run, "array<array<string>>")


def _pure(term: Column) -> Column:
    return term.rlike(f"^[{HAN}]+$")


def _ascii(c: Column) -> Column:
    return c.rlike(r"\A[\x00-\x7F]*\z")


def _syllables(right: Column) -> Column:
    return F.filter(F.split(trim_unicode(right), r"\s+"), lambda s: s != "")


def reading(readings: Column) -> Column:
    """First reading of every character, capitalised; null if one has none or there is no character."""
    known = (F.size(readings) > 0) & ~F.exists(readings, lambda r: F.size(r) == 0)
    return F.when(known, F.array_join(F.transform(readings, lambda r: F.initcap(r[0])), " "))


def reads(right: Column, readings: Column) -> Column:
    """Whether right has a syllable for each character and every one is a reading of its character."""
    s = _syllables(right)
    pairs = F.zip_with(s, readings, lambda x, r: F.coalesce(F.array_contains(r, F.lower(x)), F.lit(False)))
    return (F.size(s) == F.size(readings)) & F.forall(pairs, lambda ok: ok)


def only_readings(right: Column, readings: Column) -> Column:
    """Whether every syllable is a reading of some character of the term, in any number and order."""
    known = F.flatten(readings)
    return (F.size(known) > 0) & F.forall(_syllables(right), lambda s: F.array_contains(known, F.lower(s)))


def _sounding(right: Column, readings: Column, kind: Column) -> Column:
    """Whether right is meant as a reading: all words capitalised, one for each character unless it is a person."""
    s = _syllables(right)
    return F.forall(s, lambda x: x.rlike(r"^\p{Lu}")) & ((F.size(s) == F.size(readings)) | (kind == "person"))


def transliteration_suspect(term: Column, right: Column, kind: Column, readings: Column, western: Column) -> Column:
    """Whether a name's form is neither a reading, nor a foreign name, nor one that reconcile() mends; false for nulls and other kinds."""
    s = _syllables(right)
    foreign = _ascii(right) & ((F.size(s) == 1) | western)
    told = F.when(~_pure(term) | foreign, False).when((F.size(s) == 0) | right.rlike(f"[{HAN}]"), True).when(reads(right, readings) | only_readings(right, readings), False)
    return F.when((term != "") & (right != "") & kind.isin(*KINDS), told.otherwise(~_sounding(right, readings, kind))).otherwise(False)


def reconcile(term: Column, right: Column, kind: Column, readings: Column, western: Column) -> Column:
    """right, or the term's reading where right is left in the source's script, hyphenated, or meant as a reading and isn't one.
    Meanings, foreign names, other kinds and terms with an unknown character stay."""
    own = F.coalesce(reading(readings), right)
    s = _syllables(right)
    foreign = _ascii(right) & ((F.size(s) == 1) | western)
    mended = F.when(~_pure(term), right).when(right.rlike(f"[{HAN}]"), own).when(foreign, right).when(F.contains(right, F.lit("-")), own)
    mended = mended.when(~_sounding(right, readings, kind) | reads(right, readings), right).otherwise(own)
    return F.when((term != "") & (right != "") & kind.isin(*KINDS), mended).otherwise(right)


def is_loanword(right: Column) -> Column:
    return F.coalesce(F.lower(trim_unicode(right)).isin(*LOANWORDS), F.lit(False))


def is_syllable(word: Column, more: Sequence[str] = ()) -> Column:
    """Whether a lower-case word without marks can be a syllable of the target language; more: syllables besides the rule's."""
    return (word.rlike(SYLLABLE) | word.isin(*more)) if more else word.rlike(SYLLABLE)


def english_meaning(right: Column, kind: Column, western: Column, common: Sequence[str], more: Sequence[str] = ()) -> Column:
    """Whether a form is English, not the target language: a romanisation with tone marks; one word of `common` that doesn't
    write a foreign name; several words with one of `common` or a function word, or without a syllable or loanword of two
    letters or more. Names of persons in Latin letters aren't."""
    s = trim_unicode(F.coalesce(right, F.lit("")))
    words = F.transform(F.regexp_extract_all(s, F.lit("[A-Za-z]+"), F.lit(0)), F.lower)
    one = F.lower(s).isin(*common) if common else F.lit(False)
    told = F.exists(words, lambda w: w.isin(*common, *FUNCTION_WORDS))
    native = F.exists(words, lambda w: (F.length(w) > 1) & (is_syllable(w, more) | w.isin(*LOANWORDS)))
    named = F.coalesce(kind == "person", F.lit(False)) & s.rlike(LATIN_NAME)
    return (
        F.when(s.rlike(TONE_MARKS), True).when(~_ascii(s), False).when(~F.contains(s, F.lit(" ")), one & ~F.coalesce(western, F.lit(False)))
        .when(named | (F.size(words) == 0), False).otherwise(told | ~native)
    )


def romanised(term: Column, right: Column, readings: Column, romanisation: Column, sounds: str) -> Column:
    """The term's reading where right is its romanisation (array of a syllable for each character), else null.

    A term written in characters that sound out foreign names only is one, and stays.
    """
    term, s = trim_unicode(term), trim_unicode(right)
    own = reading(readings)
    native = term.rlike("^[一-鿿]+$") & ~term.rlike(f"^[{sounds}]+$")
    same = F.regexp_replace(F.lower(s), "[^a-z]", "") == F.lower(F.array_join(romanisation, ""))
    return F.when(native & _ascii(s) & (F.lower(s) != F.lower(own)) & same, own)


def pinyin_written(term: Column, right: Column, kind: Column, readings: Column, romanisation: Column, sounds: str) -> Column:
    """The reading that replaces a romanised form; null where there is none, and for persons, whose names may be foreign."""
    return F.when(F.coalesce(kind != "person", F.lit(True)), romanised(term, right, readings, romanisation, sounds))


def pinyin_suspect(term: Column, right: Column, readings: Column, romanisation: Column, sounds: str) -> Column:
    return romanised(term, right, readings, romanisation, sounds).isNotNull()


def reading_candidates(readings: Column, most: int = 4) -> Column:
    """array<string>: combinations of readings in order, the last character's first, distinct, most at most (a report);
    empty if a character has none."""

    def run(rows: pa.Array) -> pa.Array:
        def one(r):
            if not r or not all(r):
                return []
            seen = (" ".join(w.capitalize() for w in combo) for combo in product(*(dict.fromkeys(x) for x in r)))
            return list(islice(dict.fromkeys(islice(seen, 6 * most)), most))

        return pa.array([None if r is None else one(r) for r in rows.to_pylist()], pa.list_(pa.string()))

    return F.arrow_udf(run, "array<string>")(readings)


def checked_names(terms: DataFrame, readings: DataFrame, sounds: str, surnames: str, common: Sequence[str] = (), more: Sequence[str] = ()) -> DataFrame:
    """terms(term, right, kind and others) with readings, western, suspect, mended and english."""
    rows = terms.withColumn("readings", readings_of(readings)(F.col("term"))).withColumn("western", looks_western(F.col("term"), sounds, surnames))
    args = [F.col(c) for c in ("term", "right", "kind", "readings", "western")]
    return rows.withColumns({"suspect": transliteration_suspect(*args), "mended": reconcile(*args), "english": english_meaning(F.col("right"), F.col("kind"), F.col("western"), common, more)})
