"""Text columns: white space, and the pieces of addresses.

White space here is the Unicode set that web clients strip, wider than Spark's ``trim``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardline.functions.binding import let

SPACE = r"[\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SPACE}+|(?<!{SPACE}){SPACE}+$", "")


def without_space(text: Column) -> Column:
    return F.regexp_replace(text, f"{SPACE}+", "")


def collapsed(text: Column) -> Column:
    """Stripped, and every run of white space written as one blank."""
    return F.regexp_replace(stripped(text), f"{SPACE}+", " ")


def optional(text: Column) -> Column:
    """Stripped; null if nothing is left."""
    return F.nullif(stripped(text), F.lit(""))


def _recased(token: Column) -> Column:
    numeric = (
        F.when(token.rlike(r"^[0-9]+(?:-[0-9]+)?$"), token)
        .when(token.rlike(r"(?i)^[0-9]+(?:st|nd|rd|th)$"), F.lower(token))
        .when(token.rlike("^[0-9]+[A-Za-z]+$"), F.upper(token))
    )
    word = F.concat(F.upper(F.substr(token, F.lit(1), F.lit(1))), F.lower(F.substr(token, F.lit(2))))
    return F.when(F.substr(token, F.lit(1), F.lit(1)).between("0", "9"), F.coalesce(numeric, word)).otherwise(word)


def _recased_words(words: Column) -> Column:
    return F.array_join(F.transform(words, lambda w: _recased(F.translate(w, "–—", "--"))), " ")


def recased_address(text: Column) -> Column:
    """Each token in its customary case: house numbers kept, ordinals low, number suffixes high, words capitalised."""
    return _recased_words(F.split(collapsed(text), " "))


#: The words that introduce a unit, and what each is written as.
UNIT_WORDS = {"apt": "Apt", "apartment": "Apt", "unit": "Unit", "suite": "Ste", "ste": "Ste", "floor": "Fl", "fl": "Fl"}
def address_parts(text: Column) -> Column:
    """Struct of base, unit, key and error. A unit is the last two words, or the last one if it begins with its mark; a text
    that is nothing but a unit has an empty base and is an error, as are texts without any letter or digit. All of it is one
    value, which plans can't take apart: its fields, selected one by one, would each parse the text anew."""
    names = F.create_map(*(F.lit(x) for pair in UNIT_WORDS.items() for x in pair))
    is_value = lambda v: v.rlike("^[A-Za-z0-9][A-Za-z0-9-]*$")

    def ends(flat: Column) -> Column:
        return let(F.split(flat, " "), lambda w: F.struct(flat.alias("flat"), w.alias("words"), F.size(w).alias("n"), F.element_at(w, -1).alias("last"), F.get(w, F.size(w) - 2).alias("before")))

    def marks(e: Column) -> Column:
        last, before, n = e["last"], e["before"], e["n"]
        word = F.try_element_at(names, F.lower(F.when(before.endswith("."), F.substr(before, F.lit(1), F.length(before) - 1)).otherwise(before)))
        label = F.when(is_value(last), F.when(word.isNotNull(), word).when((before == "#") & (n > 2), F.lit("#")))
        joined = last.startswith("#") & is_value(F.substr(last, F.lit(2))) & (n > 1)
        return F.struct(e.alias("e"), label.alias("label"), joined.alias("joined"))

    def parts(m: Column) -> Column:
        e, label, joined = m["e"], m["label"], m["joined"]
        taken = F.when(label.isNotNull(), F.lit(2)).when(joined, F.lit(1)).otherwise(F.lit(0))
        value = F.upper(F.when(label.isNotNull(), e["last"]).when(joined, F.substr(e["last"], F.lit(2))))
        base = _recased_words(F.slice(e["words"], F.lit(1), e["n"] - taken))
        return F.struct(e["flat"].alias("flat"), base.alias("base"), F.coalesce(label, F.when(joined, F.lit("#"))).alias("label"), value.alias("value"))

    def judged(p: Column) -> Column:
        error = (
            F.when(p["flat"].isNull() | (p["flat"] == ""), F.lit("ADDRESS_EMPTY"))
            .when(~p["flat"].rlike("[A-Za-z0-9]"), F.lit("ADDRESS_NO_CONTENT"))
            .when(~p["base"].rlike("[A-Za-z0-9]"), F.lit("ADDRESS_UNIT_ONLY"))
        )
        return F.struct(p["base"].alias("base"), p["value"].alias("unit"), F.concat_ws(" ", p["base"], p["label"], p["value"]).alias("key"), error.alias("error"))

    def kept(p: Column) -> Column:
        ok = p["error"].isNull()
        return F.struct(*(F.when(ok, p[c]).alias(c) for c in ("base", "unit", "key")), p["error"].alias("error"))

    return let(let(let(let(let(collapsed(text), ends), marks), parts), judged), kept)


#: Short street words and what they stand for.
STREET_WORDS = {
    "AVE": "AVENUE", "BLVD": "BOULEVARD", "CT": "COURT", "DR": "DRIVE", "E": "EAST", "HWY": "HIGHWAY", "LN": "LANE", "N": "NORTH",
    "PKWY": "PARKWAY", "PL": "PLACE", "RD": "ROAD", "S": "SOUTH", "ST": "STREET", "TPKE": "TURNPIKE", "W": "WEST",
}


#: What follows the number of a numbered street.
ORDINALS = ("ST", "ND", "RD", "TH")


def _cardinal(piece: Column) -> Column:
    number = F.substr(piece, F.lit(1), F.length(piece) - 2)
    return F.when(F.right(piece, F.lit(2)).isin(*ORDINALS) & number.rlike("^[0-9]+$"), number).otherwise(piece)


def street_evidence(text: Column) -> Column:
    """A street in the form in which two spellings of it compare equal."""
    tokens = F.split(F.trim(F.regexp_replace(F.upper(text), "[^A-Z0-9-]+", " ")), " +")
    names = F.create_map(*(F.lit(x) for pair in STREET_WORDS.items() for x in pair))
    plain = F.transform(tokens, lambda t: F.array_join(F.transform(F.split(t, "-"), _cardinal), "-"))
    return F.array_join(F.transform(plain, lambda t: F.coalesce(F.try_element_at(names, t), t)), " ")


#: Fixed values.
BOROUGHS = ("STATEN ISLAND", "MANHATTAN", "BROOKLYN", "QUEENS", "BRONX")


def requested_borough(address: Column) -> Column:
    """The first of the parts after a comma that names a borough."""
    after = F.filter(F.split(address, ","), lambda _, i: i > 0)
    parts = F.transform(after, lambda s: F.trim(F.regexp_replace(F.upper(s), "[^A-Z]+", " ")))
    return F.get(F.filter(parts, lambda p: p.isin(*BOROUGHS)), F.lit(0))


def candidate_street(name: Column, label: Column) -> Column:
    return F.coalesce(name, F.split_part(label, F.lit(","), F.lit(1)))
