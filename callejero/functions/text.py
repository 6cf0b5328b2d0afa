"""Text functions as columns. A null text stays null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters read in the wrong encoding, accents, and the phonetic pairs in their order.
MOJIBAKE = (("Ã±", "ñ"), ("Ã‘", "Ñ"), ("Ã¡", "á"), ("Ã©", "é"), ("Ã­", "í"), ("Ã³", "ó"), ("Ãº", "ú"))
ACCENTED, PLAIN = "ÁÀÂÄÉÈÊËÍÌÎÏÓÒÔÖÚÙÛÜ", "AAAAEEEEIIIIOOOOUUUU"
PHONETIC = (("LL", "Y"), ("QU", "K"), ("CE", "SE"), ("CI", "SI"), ("CH", "X"), ("GE", "JE"), ("GI", "JI"), ("Z", "S"), ("V", "B"), ("C", "K"), ("H", ""), ("W", "U"))
RESOLVER_AREAS = ("ASENTAMIENTO HUMANO", "ASOCIACION PRO VIVIENDA", "PUEBLO JOVEN", "URBANIZACION", "COOPERATIVA", "ASOCIACION", "RESIDENCIAL", "CONDOMINIO", "SECTOR", "ZONA", "GRUPO")


def fix_mojibake(c: Column) -> Column:
    for wrong, right in MOJIBAKE:
        c = F.replace(c, F.lit(wrong), F.lit(right))
    return c


def fold(c: Column, keep_enye: bool = False) -> Column:
    """Upper case without accents on vowels; control characters become spaces. ``ß`` has no single upper-case letter in Java and is set first."""
    up = F.upper(F.translate(c, "ß", "ẞ"))
    up = F.translate(up, ACCENTED + ("" if keep_enye else "Ñ"), PLAIN + ("" if keep_enye else "N"))
    return F.regexp_replace(up, r"\p{Cc}", " ")


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"[\s\u0085\p{Z}]+", " "))


def key(c: Column) -> Column:
    return collapse(F.regexp_replace(fold(c), r"[^A-Z0-9\s]", " "))


def display(c: Column) -> Column:
    return collapse(F.regexp_replace(fold(c, True), "[^A-Z0-9Ñ ]", " "))


def phonetic(c: Column) -> Column:
    out = key(c)
    for a, b in PHONETIC:
        out = F.replace(out, F.lit(a), F.lit(b))
    return collapse(out)


def strip_accents(c: Column) -> Column:
    return F.translate(c, ACCENTED + ACCENTED.lower(), PLAIN + PLAIN.lower())


def title_case(c: Column) -> Column:
    words = F.split(F.lower(c), " ")
    joined = F.transform(words, lambda w, i: F.when((i > 0) & w.isin("de", "del", "la", "las", "los", "el"), w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.expr("''"), w.substr(F.lit(2), F.lit(1000)))))
    return F.array_join(joined, " ")


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; 1 for two empty texts."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longer)


def same_name(a: Column, b: Column) -> Column:
    """Every word of the name with fewer words equals, or from four letters on is one edit from, some word of the other."""
    x, y = F.split(F.translate(a, "Ñ", "N"), " "), F.split(F.translate(b, "Ñ", "N"), " ")
    short, long = F.when(F.size(x) <= F.size(y), x).otherwise(y), F.when(F.size(x) <= F.size(y), y).otherwise(x)
    return F.forall(short, lambda s: F.exists(long, lambda t: (s == t) | ((F.length(s) >= 4) & (F.levenshtein(s, t) <= 1))))


def subset(a: Column, b: Column) -> Column:
    return (F.size(a) > 0) & (F.size(F.array_except(a, b)) == 0)


def area_key(c: Column, markers: tuple[str, ...] = RESOLVER_AREAS) -> Column:
    return F.regexp_replace(key(c), f"^(?:{'|'.join(markers)}) ", "")


def house_number(c: Column) -> Column:
    """The number before any trailing non-digits; null if there is none."""
    return F.regexp_replace(c, r"[^0-9]+$", "").try_cast("int")


def anchor_number(c: Column) -> Column:
    return F.regexp_extract(F.trim(c), r"^(\d{1,5})\s*[A-Za-z]?$", 1).try_cast("int")


def mask_pii(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+", "<CORREO>"), "[0-9]{7,}", "<NUM>")


def address_hash(match_key: Column, ubigeo: Column) -> Column:
    return F.sha2(F.concat_ws("|", match_key, ubigeo), 256)


def pseudonym(c: Column) -> Column:
    return F.left(F.md5(c), F.lit(12))


def fnv1a(c: Column) -> tuple[Column, Column]:
    """FNV-1a of the UTF-8 bytes as two unsigned 32-bit halves (high, low) in longs: no overflow under ANSI."""
    octets = F.transform(F.sequence(F.lit(1), F.octet_length(c)), lambda i: F.conv(F.hex(F.substring(F.encode(c, "UTF-8"), i, 1)), 16, 10).cast("long"))
    octets = F.when(F.octet_length(c) > 0, octets).otherwise(F.array().cast("array<long>"))
    start = F.struct(F.lit(3421674724).cast("long").alias("hi"), F.lit(2216829733).cast("long").alias("lo"))
    low32 = F.lit(0xFFFFFFFF).cast("long")

    def step(s: Column, x: Column) -> Column:
        l = s["lo"].bitwiseXOR(x)  # noqa: E741
        hi = s["hi"] * 435 + F.shiftrightunsigned(l * 435, 32) + F.shiftleft(l.bitwiseAND(F.lit(16777215).cast("long")), 8)
        return F.struct(hi.bitwiseAND(low32).alias("hi"), (l * 435).bitwiseAND(low32).alias("lo"))

    out = F.aggregate(octets, start, step)
    return out["hi"], out["lo"]


def fnv_mod100(c: Column) -> Column:
    hi, lo = fnv1a(c)
    return (((hi % 100) * 96 + lo) % 100).cast("int")


def leak_fragments(c: Column) -> Column:
    """Around the first all-digit word after the first: the two words before with it, with the word before (from three digits), and with a number after."""
    w = F.split(key(c), " ")
    at = F.get(F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - 1)), lambda i: F.get(w, i).rlike("^[0-9]+$")), F.lit(0))
    n = F.get(w, at)
    parts = F.array(
        F.when(at >= 2, F.concat_ws(" ", F.get(w, at - 2), F.get(w, at - 1), n)),
        F.when(F.length(n) >= 3, F.concat_ws(" ", F.get(w, at - 1), n)),
        F.when(F.get(w, at + 1).rlike("^[0-9]+$"), F.concat_ws(" ", n, F.get(w, at + 1))),
    )
    return F.when(at.isNull(), F.array().cast("array<string>")).otherwise(F.array_distinct(F.array_compact(parts)))


def shape(parts: dict[str, Column]) -> Column:
    """Names of the parts that are present, joined by `` + ``."""
    return F.array_join(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit("")) != "", F.lit(name)) for name, c in parts.items()])), " + ")


def compared(expected: Column, got: Column) -> Column:
    return F.when(expected == got, "igual").when(F.coalesce(got, F.lit("")) == "", "abstencion").otherwise("distinto")
