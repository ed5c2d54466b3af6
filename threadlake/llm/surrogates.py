"""Personal data replaced by keyed surrogates of the same type and format; DataFrame functions only.

1. Entities are found by patterns, each type by its own, and written once: e-mail addresses, phone and card numbers,
   IP addresses, account numbers, social security numbers, secrets in hexadecimal, access tokens and titled names. Every
   word of a name found with a title is one without it too, anywhere in the same text.
2. The different (type, value) pairs get a surrogate made from SHA-256 of key, type, value and attempt. A value means
   what is written: letters in one case, digits without separators, of a name each word with the gender of its title.
   So one entity has one surrogate wherever and however it is written: Mr. John Smith, Mr. Smith and John share theirs.
   A title that says no gender takes that of the same word with another title in the text; initials become initials.
3. Collisions: of values with one surrogate, and values whose surrogate is itself a value of the corpus, all but a
   first one take the next attempt until no two are alike. From the attempt WIDER on, surrogates grow longer, so that
   small formats don't run out.
4. Surrogates are filled into the entity's own format: digits for digits, letters of the same case and script for
   letters, valid check digits for valid ones, names of the title's gender.

Results: a null text stays null, an empty one empty; texts without entities stay as they are; repeated rows are each
replaced, rows with a null id too; an empty table gives no rows; all other columns are kept as they are. The number of
entities is the last column, n_entities, with underscores after it where docs has such a column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from threadlake.llm.rules import let
from threadlake.llm.storage import durable

_TITLES = {"m": "Mr|Mister|Herr|Señor|Monsieur|Sir|Г-н", "f": "Mrs|Ms|Miss|Frau|Señora|Señorita|Madame|Mme|Г-жа", "n": "Dr|Doctor|Doktor|Docteur|Prof|Professor|Professeur|Profesor"}
_TITLE = rf"(?:{'|'.join(_TITLES.values())})\.? "
_WORD = r"\p{Lu}(?:\p{Ll}+|['’]\p{Lu}\p{Ll}+)(?:['’-]\p{Lu}?\p{Ll}+)*"
_TOKEN = r"(?:(?:sk|pk|rk)[-_](?:[a-z]+[-_])?|gh[pousr]_|AKIA|xox[abprs]-|AIza)"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_HEX, _SEP = "[0-9A-Fa-f]{1,4}", r"[\p{Zs}.()/-]{0,2}"
#: Countries by the length of their account numbers.
_IBANS = {15: "NO", 16: "BE", 18: "DK|FI|FO|GL|NL|SD", 19: "MK|SI", 20: "AT|BA|EE|KZ|LT|LU|MN|XK", 21: "CH|HR|LI|LV", 22: "BG|BH|CR|DE|GB|GE|IE|ME|RS|VA", 23: "AE|GI|IL|IQ|OM|SO|TL", 24: "AD|CZ|ES|MD|PK|RO|SA|SE|SK|TN|VG", 25: "LY|PT|ST", 26: "IS|TR", 27: "BI|DJ|FR|GR|IT|MC|MR|SM", 28: "AL|AZ|BY|CY|DO|GT|HU|LB|NI|PL|SV", 29: "BR|EG|PS|QA|UA", 30: "JO|KW|MU|YE", 31: "MT|SC", 32: "LC", 33: "RU"}
_IBAN = "|".join(rf"(?:{countries})\d{{2}}(?:[ -]?[A-Z0-9]){{{n - 4}}}" for n, countries in _IBANS.items())
#: International; then national with an area code, with a trunk 0 but no date, and of nine and eleven digits.
_PHONES = [
    r"\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}",
    rf"\+\d(?:{_SEP}\d){{7,14}}",
    r"\(\d{3}\) ?\d{3}[ .-]\d{4}",
    r"(?:1[ .-])?[2-9]\d{2}[ .-][2-9]\d{2}[ .-]\d{4}",
    rf"(?!\d{{1,2}}[./-]\d{{1,2}}[./-]\d{{4}})\(?0[1-9](?:{_SEP}\d){{7,10}}",
    r"[6-9]\d{2}(?:[ -]\d{3}){2}",
    r"[6-9]\d{2}(?:[ -]\d{2}){3}",
    r"8[ -]?\(?\d{3}\)?[ -]\d{3}[ -]\d{2}[ -]\d{2}",
]
#: In the order in which they are tried at a place.
PATTERNS = {
    "email": r"[\p{L}\p{N}_%+-]+(?:\.[\p{L}\p{N}_%+-]+)*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "secret": r"(?<![\p{L}\p{N}])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![\p{L}\p{N}])",
    "token": rf"(?<![\p{{L}}\p{{N}}])(?={_TOKEN}[A-Za-z0-9_-]*\d){_TOKEN}[A-Za-z0-9_-]{{16,}}(?![\p{{L}}\p{{N}}])",
    "ip6": rf"(?<![\p{{L}}\p{{N}}:.])(?=[0-9A-Fa-f:]*\d|(?:[0-9A-Fa-f]*:){{3}})(?:(?:[0-9A-Fa-f]{{0,4}}:){{2,7}}{_OCTET}(?:\.{_OCTET}){{3}}|(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{1,7}}:(?:{_HEX}(?::{_HEX}){{0,5}})?|::{_HEX}(?::{_HEX}){{0,6}})(?![\p{{L}}\p{{N}}:])",
    "iban": rf"(?<![\p{{L}}\p{{N}}])(?:{_IBAN}|[A-Z]{{2}}\d{{2}}(?: ?\d{{4}}){{3,6}}(?: ?\d{{1,3}})?)(?![\p{{L}}\p{{N}}])",
    "card": r"(?<![\p{L}\p{N}])(?:\d{4}(?:[ -]?\d{4}){3}(?:[ -]\d{3})?|\d{4}[ -]\d{6}[ -]\d{4,5}|[3-6]\d{12,18})(?![\p{L}\p{N}])",
    "ssn": r"(?<![\p{L}\p{N}-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}-])",
    "ip": rf"(?<![\p{{L}}\p{{N}}.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?[\p{{L}}\p{{N}}])",
    "phone": rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(_PHONES)})(?![\p{{L}}\p{{N}}])",
    "name": rf"(?<!\p{{L}}){_TITLE}(?:\p{{Lu}}\.? )?{_WORD}(?: {_WORD})?",
}
ANY = "|".join(PATTERNS.values())
#: A text that this doesn't match has no entity; it is cheaper to look for.
_HINT = rf"[0-9@]|:[A-Fa-f]{{0,4}}:|{_TITLE}\p{{Lu}}"
_IS_TITLE = rf"^{_TITLE}"
_LETTERS = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "àáâäçèéêëìíîïñòóôöùúûü", "ÀÁÂÄÇÈÉÊËÌÍÎÏÑÒÓÔÖÙÚÛÜ", "абвгдежзийклмнопрстуфхцчшщыэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЫЭЮЯ", "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ")
_SYLLABLES = {"latin": "ba be bo da de do fa fe ka ke la le li lo ma me mi na ne no ra re ri ro sa se ta te ti va ve vo".split(), "cyrillic": "ба бе бо да де до фа фе ка ке ла ле ли ло ма ме ми на не но ра ре ри ро са се та те ти ва ве во".split()}
_ENDS = {"latin": {"m": "n", "f": "na", "n": ""}, "cyrillic": {"m": "н", "f": "на", "n": ""}}
WIDER, ATTEMPTS = 6, 30


def _words(raw: Column) -> Column:
    return F.split(F.regexp_replace(raw, _IS_TITLE, ""), " ")


def _is_initial(word: Column) -> Column:
    return word.rlike(r"^\p{Lu}\.?$")


def names_in(text: Column) -> Column:
    """The words, each after its gender, of the names with a title in a text, without repeats; null if there is none."""
    found = F.regexp_extract_all(text, F.lit(PATTERNS["name"]), F.lit(0))
    gender = lambda raw: F.coalesce(*(F.when(raw.rlike(rf"^(?:{_TITLES[g]})\.? "), F.lit(f"{g} ")) for g in "mf"), F.lit("n "))
    words = F.flatten(F.transform(found, lambda raw: F.transform(F.filter(_words(raw), lambda w: ~_is_initial(w)), lambda w: F.concat(gender(raw), w))))
    return F.when(text.rlike(_HINT), F.when(text.rlike(PATTERNS["name"]), F.array_distinct(words)))


def pattern_of(names: Column) -> Column:
    """ANY and, without a title, the words of the names, longer ones first; they are letters, hyphens and apostrophes only."""
    every = F.array_distinct(F.transform(names, lambda v: F.substring(v, F.lit(3), F.length(v))))
    longest = F.transform(F.array_sort(F.transform(every, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), lambda x: x["w"])
    return F.concat(F.lit(ANY + r"|(?<!\p{L})(?:"), F.array_join(longest, "|"), F.lit(r")(?!\p{L})"))


def entities(text: Column, names: Column) -> Column:
    """The entities of a text in order, as an array of strings; names as by names_in."""
    found = F.when(names.isNull(), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.regexp_extract_all(text, pattern_of(names), F.lit(0)))
    return F.when(text.rlike(_HINT), found)


def meant(word: Column, raw: Column, names: Column) -> Column:
    """The word of a name after its gender: that of raw's own title, or of the word elsewhere in the text."""
    own = lambda g: F.when(raw.rlike(rf"^(?:{_TITLES[g]})\.? "), F.concat(F.lit(f"{g} "), word))
    other = lambda g: F.when(F.array_contains(names, F.concat(F.lit(f"{g} "), word)), F.concat(F.lit(f"{g} "), word))
    return F.coalesce(own("m"), own("f"), other("m"), other("f"), F.concat(F.lit("n "), word))


def kind_of(raw: Column) -> Column:
    found = F.lit("name")
    for name, pattern in reversed(list(PATTERNS.items())[:-1]):
        found = F.when(raw.rlike(f"^(?:{pattern})$"), F.lit(name)).otherwise(found)
    return found


def value_of(kind: Column, raw: Column) -> Column:
    """What an entity that is no name means, however it is written."""
    digits = F.regexp_replace(raw, r"[^A-Z0-9]", "")
    return F.when(kind.isin("email", "secret", "ip6"), F.lower(raw)).when(kind.isin("ip", "token"), raw).otherwise(digits)


def _noise(key: str, kind: Column, value: Column, attempt: Column) -> Column:
    """384 hexadecimal digits."""
    seed = F.concat_ws("\x01", F.lit(key), kind, value, attempt.cast("string"))
    return F.concat(*(F.sha2(F.concat(seed, F.lit(f"\x01{n}")), 256) for n in range(6)))


def _number(noise: Column, place: Column, digits: int = 4) -> Column:
    return F.conv(F.substring(noise, (place * digits) % (384 - digits) + 1, F.lit(digits)), 16, 10).cast("int")


def _scrambled(text: Column, noise: Column, hexadecimal: bool = False) -> Column:
    """Every letter or digit replaced by one of its own alphabet."""

    def one(c: Column, i: Column) -> Column:
        n = _number(noise, i)
        if hexadecimal:
            return F.when(c.rlike("[0-9a-f]"), F.substring(F.lit("0123456789abcdef"), n % 16 + 1, F.lit(1))).otherwise(c)
        out = c
        for letters in _LETTERS:
            out = F.when(F.instr(F.lit(letters), c) > 0, F.substring(F.lit(letters), n % len(letters) + 1, F.lit(1))).otherwise(out)
        return out

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _luhn(digits: Column) -> Column:
    """The sum that is a multiple of ten if the last digit is right."""
    each = F.transform(F.reverse(F.split(digits, "")), lambda c, i: let(c.cast("int") * (i % 2 + 1), lambda x: F.when(x > 9, x - 9).otherwise(x)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x)


def _name(value: Column, noise: Column, long: Column) -> Column:
    """A word of a name, with an ending of its gender."""

    def of(script: str) -> Column:
        s, n = F.array(*map(F.lit, _SYLLABLES[script])), len(_SYLLABLES[script])
        part = lambda k: F.element_at(s, _number(noise, F.lit(k)) % n + 1)
        end = F.coalesce(*(F.when(value.startswith(f"{g} "), F.lit(_ENDS[script][g])) for g in "mf"), F.lit(""))
        return F.initcap(F.concat(part(0), part(1), part(2), F.when(long, F.concat(part(3), part(4))).otherwise(""), end))

    return F.concat(F.substring(value, 1, 2), F.when(F.substring(value, 3, 1).rlike(r"\p{IsCyrillic}"), of("cyrillic")).otherwise(of("latin")))


def surrogate_value(key: str, kind: Column, value: Column, attempt: Column) -> Column:
    """The value that stands for a value at an attempt; the same for the same arguments everywhere."""
    long = attempt >= WIDER

    def made(noise: Column) -> Column:
        local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
        top = F.substring_index(domain, ".", -1)
        host = F.substring(domain, F.lit(1), F.length(domain) - F.length(top))
        extra = F.when(long, F.substring(noise, 300, 8)).otherwise("")
        email = F.concat(_scrambled(local, noise), extra, F.lit("@"), _scrambled(host, F.reverse(noise)), top)
        digits = _scrambled(value, noise)
        card = F.substring(digits, F.lit(1), F.length(digits) - 1)
        check = (10 - _luhn(F.concat(card, F.lit("0"))) % 10) % 10
        card = F.when(_luhn(value) % 10 == 0, F.concat(card, check.cast("string"))).otherwise(digits)
        ip = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (_number(noise, i) % 254 + 1).cast("string")), ".")
        ip6 = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.substring(noise, i * 4 + 1, F.lit(4))), ":")
        ip6 = F.when(long | value.contains("."), ip6).otherwise(_scrambled(value, noise, True))
        # The country code of a phone number stands in its first digit.
        phone = F.concat(F.substring(value, 1, 1), F.substring(digits, F.lit(2), F.length(digits)))
        iban = F.concat(F.substring(value, 1, 2), F.substring(digits, F.lit(3), F.length(digits)))
        return (
            F.when(kind == "email", email)
            .when(kind == "secret", _scrambled(value, noise, True))
            .when(kind == "card", card)
            .when(kind == "ip", ip)
            .when(kind == "ip6", ip6)
            .when(kind == "phone", phone)
            .when(kind == "iban", iban)
            .when(kind == "name", _name(value, noise, long))
            .when(kind == "token", let(F.regexp_extract(value, f"^{_TOKEN}", 0), lambda p: F.concat(p, _scrambled(F.substring(value, F.length(p) + 1, F.length(value)), noise))))
            .otherwise(digits)
        )

    return let(_noise(key, kind, value, attempt), made)


def _filled(raw: Column, value: Column) -> Column:
    """raw with its letters and digits replaced, in turn, by those of value."""
    places = F.regexp_replace(raw, r"[^A-Z0-9]", "")
    step = lambda a, c: F.when(c.rlike("[A-Z0-9]"), F.struct(F.concat(a["t"], F.substring(value, a["n"] + 1, F.lit(1))).alias("t"), (a["n"] + 1).alias("n"))).otherwise(F.struct(F.concat(a["t"], c).alias("t"), a["n"].alias("n")))
    filled = F.aggregate(F.split(raw, ""), F.struct(F.lit("").alias("t"), F.lit(0).alias("n")), step, lambda a: a["t"])
    return F.when(F.length(places) == F.length(raw), value).otherwise(filled)


def written(kind: Column, raw: Column, value: Column) -> Column:
    """A surrogate value in the format of the entity that it replaces; of a name one word."""
    upper = (kind == "secret") & raw.rlike("[A-F]")
    initial = F.when((kind == "email") & (F.lower(raw) != raw), F.when(F.upper(raw) == raw, F.upper(value)).otherwise(F.concat(F.upper(F.substring(value, 1, 1)), F.substring(value, F.lit(2), F.length(value))))).otherwise(value)
    return F.when(kind == "name", F.substring(value, F.lit(3), F.length(value))).when(upper, F.upper(value)).when(kind.isin("email", "secret", "ip", "token", "initial"), initial).when(kind == "ip6", F.when(F.lower(raw) != raw, F.upper(value)).otherwise(value)).otherwise(_filled(raw, value))


def assignments(values: DataFrame, key: str) -> DataFrame:
    """(kind, value, surrogate) of different (kind, value): no two alike, and none a value of the table."""
    values = durable(values.select("kind", "value").distinct(), "values")
    taken = None  # settled so far
    todo = values.withColumn("attempt", F.lit(0))
    for attempt in range(ATTEMPTS):
        made = todo.select("kind", "value", surrogate_value(key, F.col("kind"), F.col("value"), F.lit(attempt)).alias("surrogate"))
        free = made.join(values.select("kind", F.col("value").alias("surrogate")), ["kind", "surrogate"], "left_anti")
        if taken is not None:
            free = free.join(taken.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        settled = free.groupBy("kind", "surrogate").agg(F.min("value").alias("value")).select("kind", "value", "surrogate")
        settled = durable(settled, "surrogates")
        taken = settled if taken is None else taken.unionByName(settled)
        todo = durable(todo.join(settled, ["kind", "value"], "left_anti").select("kind", "value"), "values")
        if todo.isEmpty():
            return taken
    raise ValueError(f"values of one format are more than its surrogates, after {ATTEMPTS} attempts")


def replace(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the entities of text_col replaced, and their number as the last column. Who knows the key can make the
    surrogates of guessed values, so it is to be kept like a password."""
    count_col = "n_entities"
    while count_col in docs.columns:
        count_col += "_"
    rows = docs.withColumn("__text", F.col(text_col).cast("string")).withColumn("__sum", F.xxhash64("__text")).withColumn("__names", names_in(F.col("__text")))
    found = rows.select(F.col(id_col).alias("id"), F.col("__sum").alias("sum"), entities(F.col("__text"), F.col("__names")).alias("e"), F.col("__names").alias("names")).filter("size(e) > 0").distinct()
    found = durable(found, "entities").select("id", "sum", "names", F.posexplode("e").alias("n", "raw")).withColumn("kind", kind_of(F.col("raw")))
    piece = lambda kind, value: F.struct(kind.alias("kind"), value.alias("value"))
    words = F.transform(_words(F.col("raw")), lambda w: piece(F.when(_is_initial(w), "initial").otherwise("name"), F.when(_is_initial(w), w).otherwise(meant(w, F.col("raw"), F.col("names")))))
    pieces = F.when(F.col("kind") == "name", words).otherwise(F.array(piece(F.col("kind"), value_of(F.col("kind"), F.col("raw")))))
    title = F.when(F.col("kind") == "name", F.regexp_extract("raw", _IS_TITLE, 0)).otherwise("")
    found = found.select("id", "sum", "n", "raw", title.alias("title"), F.posexplode(pieces).alias("nth", "piece")).select("id", "sum", "n", "raw", "title", "nth", "piece.*")
    found = durable(found, "pieces")  # read by each of the steps below, and dear to make: it tries all patterns on each entity
    known = assignments(found.filter("kind <> 'initial'"), key)
    # There are too few initials to keep them apart.
    letter = _scrambled(F.col("value"), _noise(key, F.col("kind"), F.col("value"), F.lit(0)))
    met = found.join(known, ["kind", "value"], "left").withColumn("surrogate", F.coalesce("surrogate", letter))
    part = F.struct("n", "nth", "title", written(F.col("kind"), F.col("raw"), F.col("surrogate")).alias("s"))
    whole = lambda all_, x: F.concat(x["title"], F.array_join(F.transform(F.filter(all_, lambda y: y["n"] == x["n"]), lambda y: y["s"]), " "))
    new = met.groupBy("id", "sum").agg(F.array_sort(F.collect_list(part)).alias("all"))
    new = new.select("id", "sum", F.transform(F.filter("all", lambda x: x["nth"] == 0), lambda x: F.when(x["title"] == "", x["s"]).otherwise(whole(F.col("all"), x))).alias("__new"))
    joined = rows.join(new.withColumnsRenamed({"id": "__id", "sum": "__key"}), (F.col(id_col).eqNullSafe(F.col("__id"))) & (F.col("__sum") == F.col("__key")), "left")
    stitched = let(F.when(F.col("__names").isNull(), F.split("__text", ANY, -1)).otherwise(F.split("__text", pattern_of(F.col("__names")), -1)), lambda gaps: F.array_join(F.flatten(F.zip_with(gaps, F.col("__new"), lambda g, s: F.array(g, F.coalesce(s, F.lit(""))))), ""))
    out = joined.withColumn(text_col, F.when(F.col("__new").isNull(), F.col("__text")).otherwise(stitched))
    return out.withColumn(count_col, F.greatest(F.size(F.coalesce("__new", F.array())), F.lit(0))).select(*docs.columns, count_col)
