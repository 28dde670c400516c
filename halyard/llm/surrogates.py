"""Personal data replaced by keyed surrogates (DataFrame operations only).

Entities are mail addresses, phone numbers, card numbers and IBANs with valid check digits, IPv4 and IPv6 addresses, and
names: after a title, or beginning with a common given name. An entity is brought to a canonical form (lower case; of
numbers the digits alone), its letters and digits go through a keyed permutation of the forms of the same format, and
what comes out is written the way the occurrence was: same length, case, separators and marks. Letters stay in their
script and kind (vowels, consonants, accented ones, ...), so surrogates are as pronounceable as what they replace. Titles,
particles and the endings of names that tell a gender stay; so do country codes, top-level domains and issuer digits;
check digits are made anew. One domain's addresses stay at one domain, and every word of a name has one surrogate, so that
"Mrs. Anna Smith", "Mrs. Smith" and "ANNA SMITH" stay one person.

Distinctness: a permutation gives no two canonical forms of one format the same surrogate, and never the form itself. It is
a Feistel network over the symbols of the form, run forth, shifted by a step, and run back, with HMAC-SHA256 under the
secret key as its round function; a format may be used up entirely. ``collisions`` checks a corpus for entities that share
a surrogate. Coreference: a surrogate follows from key and canonical form alone. So texts are rewritten in one pass, with
no join and no shuffle.

Nulls: null texts stay null, doc_id may be null or repeated, and equal rows stay equal. Texts of any length are scanned
whole. An empty table gives an empty result. Other columns stay as they were, whatever their names, but for n_chars, which
is the new text's length where it was the old one's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The key of the registered query and the pipeline's tests. A real corpus takes one from its own secret store.
DEMO_KEY = "halyard-demo-key"
#: Titles by gender, particles within names, and given names that mark a name without a title.
FEMALE_TITLES, MALE_TITLES = "Mrs|Ms|Miss|Mme|Madame|Frau|Señora|Sra|Doña|Госпожа|Κυρία", "Mr|Mister|Monsieur|Herr|Señor|Sr|Don|Господин|Κύριος"
OTHER_TITLES = "Dr|Prof|Professor|Доктор|Профессор"
PARTICLES = "van|von|de|der|den|del|della|di|da|dos|la|le|bin|ibn|al|el|zu|ter"
GIVEN = (
    "James|John|Robert|Michael|William|David|Richard|Joseph|Thomas|Charles|Daniel|Matthew|Anthony|Steven|Andrew|Mary|Patricia|Jennifer|Linda|"
    "Elizabeth|Barbara|Susan|Jessica|Sarah|Karen|Nancy|Margaret|Hans|Jürgen|Klaus|Stefan|Andreas|Ursula|Monika|Petra|Sabine|Pierre|Jean|Michel|"
    "Philippe|Nathalie|Isabelle|Sylvie|Carlos|José|Juan|Manuel|Carmen|Ana|Lucía|Иван|Сергей|Дмитрий|Алексей|Андрей|Анна|Мария|Елена|Ольга|Наталья|Γιώργος|Δημήτρης|Μαρία|Ελένη"
)
#: Symbols that are exchanged for one another, by kind: fixed values.
KINDS = (
    "0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "àáâãäåæèéêëìíîïòóôõöøùúûüýāăąēĕėęěĩīĭįōŏőũūŭůűųŷ", "çðñþćĉċčďđĝğġģĥħĵķĺļľłńņňŕŗřśŝşšţťŧŵźżž",
    "аеёиоуыэюяіїє", "бвгджзйклмнпрстфхцчшщъь", "αεηιουω", "άέήίόύώ", "βγδζθκλμνξπρστφχψ",
)
SYMBOLS = "".join(KINDS)
#: Scripts without case, by their ranges of code points: Hebrew, Arabic, Devanagari, kana, ideographs, Hangul.
RANGES = ((0x5D0, 0x5EA), (0x621, 0x63A), (0x641, 0x64A), (0x905, 0x939), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3))
#: Country codes of two digits; 1 and 7 have one, others three.
TWO_DIGITS = "2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
#: Endings of names that stay: they tell a gender.
ENDING = "(?:ская|ский|ова|ева|ёва|ина|ына|ов|ев|ёв|ин|ын|ая|ий|ый|ис|ος|ου|ης|ας|.)$"

# Parts of an address have their greatest lengths, so that long runs of letters cost no more than others.
_LN = r"[\p{L}\p{N}]"
MAIL = rf"{_LN}(?:[\p{{L}}\p{{N}}._%+-]{{0,62}}[\p{{L}}\p{{N}}_%+-])?@(?:{_LN}(?:[\p{{L}}\p{{N}}-]{{0,61}}{_LN})?\.){{1,20}}(?:xn--[A-Za-z0-9-]{{1,58}}[A-Za-z0-9]|\p{{L}}{{2,24}})"
ADDRESS = r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?![0-9]|\.[0-9])"
_H = "[0-9A-Fa-f]{1,4}"
ADDRESS6 = rf"(?<![0-9A-Za-z:.])(?:(?:{_H}:){{7}}{_H}|(?=[0-9A-Fa-f:]{{0,39}}[0-9])(?:{_H}:){{2,6}}(?::{_H}){{1,5}}|(?=[0-9A-Fa-f:]{{0,39}}[0-9]){_H}:(?::{_H}){{2,6}})(?![0-9A-Za-z:])"
IBAN = r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![0-9A-Za-z])"
CARD = r"(?<![0-9A-Za-z.+-])[0-9](?:[0-9]{12,18}|[0-9]{3}(?:[ -][0-9]{4}){2}[ -][0-9]{1,7})(?![0-9A-Za-z]|[.-][0-9])"
_END = r"(?![0-9A-Za-z]|[.-][0-9])"
PHONE = (
    rf"(?<![0-9A-Za-z+.-])(?:(?:\+[1-9][0-9]{{0,2}}[ .-]?)?(?:\([0-9]{{2,4}}\)[ .-]?[0-9]{{3,4}}[ .-]?[0-9]{{3,4}}|[0-9]{{3}}[.-][0-9]{{3}}[.-][0-9]{{4}}|[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}){_END}"
    rf"|\+[1-9][0-9]{{0,2}}(?:[ .-]?[0-9]{{2,4}}){{2,5}}{_END}|0[1-9][0-9]{{1,3}}[ /-][0-9]{{5,8}}{_END})"
)
_CAPS = "|".join({t.upper() for t in "|".join((FEMALE_TITLES, MALE_TITLES, OTHER_TITLES)).split("|")} - set("|".join((FEMALE_TITLES, MALE_TITLES, OTHER_TITLES)).split("|")))
TITLES = "|".join((FEMALE_TITLES, MALE_TITLES, OTHER_TITLES, "|".join(sorted(_CAPS.split("|")))))
_WORD = r"(?:\p{Lu}\.(?=\x20)|\p{Lu}[\p{L}\p{M}]{0,40}(?:['’-][\p{L}\p{M}]{1,40}){0,3}(?=[^\p{L}]|$)|\p{Lo}[\p{Lo}\p{M}]{1,20})"
_NEXT = rf"(?:\x20(?:(?:{PARTICLES})\x20){{0,3}}{_WORD})"
NAME = rf"(?<!\p{{L}})(?:(?:{TITLES})\.?\x20(?:(?:{TITLES})\.?\x20)?{_WORD}{_NEXT}{{0,7}}|(?=\p{{Lu}})(?:{GIVEN}|{GIVEN.upper()}){_NEXT}{{1,7}})"
ENTITY = f"{MAIL}|{ADDRESS6}|{ADDRESS}|{IBAN}|{CARD}|{PHONE}|{NAME}"
MIGHT = rf"@|[0-9][0-9 ()./-]{{5}}|[0-9A-Fa-f]:[0-9A-Fa-f]{{0,4}}:|[A-Z]{{2}}[0-9]{{2}}\x20?[A-Z0-9]{{4}}|(?<!\p{{L}})(?=\p{{Lu}})(?:(?:{TITLES})\.?\x20[\p{{Lu}}\p{{Lo}}]|(?:{GIVEN}|{GIVEN.upper()})\x20)"


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def _lower(text: Column) -> Column:
    """In lower case, where that keeps every letter's place."""
    return _let(F.lower(text), lambda x: F.when(F.length(x) == F.length(text), x).otherwise(text))


def _letters(text: Column) -> Column:
    return F.when(F.length(text) > 0, F.split(text, "")).otherwise(F.array().cast("array<string>"))


def luhn_total(digits: Column) -> Column:
    """The check sum of a string of digits, counted from its end."""
    n = F.length(digits)
    at = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(digits, n - i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1))
    return F.aggregate(F.transform(at, lambda x: F.when(x > 9, x - 9).otherwise(x)), F.lit(0), lambda a, x: a + x)


def iban_rest(compact: Column) -> Column:
    """An IBAN's number modulo 97: letters count from 10 on, the first four symbols come last."""
    turned = F.concat(F.substr(compact, F.lit(5)), F.substring(compact, 1, 4))
    step = lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(_letters(turned), F.lit(0), step)


def kind(entity: Column) -> Column:
    """The entity's type, or null for digits without a valid check digit."""
    digits = F.regexp_replace(entity, "[^0-9]", "")
    card = entity.rlike(f"^(?:{CARD})$") & (F.length(digits) >= 13) & (F.length(digits) <= 19)
    iban = entity.rlike(f"^(?:{IBAN})$")
    return (
        F.when(entity.contains("@"), "mail").when(entity.contains(":"), "address6").when(entity.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), "address")
        .when(iban, F.when(iban_rest(F.regexp_replace(entity, " ", "")) == 1, F.lit("iban"))).when(entity.rlike(r"^\p{L}"), "name")
        .when(card, F.when(luhn_total(digits) % 10 == 0, F.lit("card"))).otherwise("phone")
    )


def found(text: Column) -> Column:
    """The matches of the pattern in a text, in order."""
    return F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))


def _hmac(key: str, message: Column) -> Column:
    """HMAC-SHA256 as hexadecimal digits."""
    import hashlib

    secret = key.encode()
    secret = (hashlib.sha256(secret).digest() if len(secret) > 64 else secret).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(b ^ pad for b in secret)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))), 256)


def permuted(values: Column, radix: Column, tweak: Column, key: str) -> Column:
    """Numbers ``values``, each below its ``radix`` of two or more, as others of the same radixes: for every tweak a
    permutation without fixed points. Even places are shifted by what follows from the odd ones and the other way round,
    three times; then one place is shifted by a number that is not zero, and all is undone."""
    number = lambda digest, i: F.conv(F.substring(digest, (i % 16) * 4 + 1, F.lit(4)), 16, 10).cast("int") + 7 * i

    def step(now: Column, k: Column) -> Column:
        turn = F.when(k < 0, -k).otherwise(k) % 2  # rounds 1 2 3 shift odd, even, odd places
        others = F.filter(now, lambda v, i: i % 2 != turn)
        digest = _hmac(key, F.concat_ws(":", tweak, F.abs(k).cast("string"), F.array_join(others.cast("array<string>"), ",")))
        sign = F.signum(k).cast("int")
        turned = _let(digest, lambda d: F.transform(now, lambda v, i: F.when(i % 2 == turn, F.pmod(v + sign * number(d, i), radix[i])).otherwise(v)))
        shifted = _let(
            _hmac(key, F.concat(tweak, F.lit(":shift"))),
            lambda d: F.transform(now, lambda v, i: F.when(i == 0, F.pmod(v + 1 + F.pmod(number(d, i), radix[i] - 1), radix[i])).otherwise(v)),
        )
        return F.when(k == 0, shifted).otherwise(turned)

    return F.aggregate(F.array(*(F.lit(k) for k in (1, 2, 3, 0, -3, -2, -1))), values, step)


def _symbol(c: Column) -> Column:
    """A letter's or digit's kind as (offset, radix, value); radix 1 for all else."""
    place, code = F.instr(F.lit(SYMBOLS), c) - 1, F.ascii(c)
    out = F.struct((-code).alias("o"), F.lit(1).alias("r"), F.lit(0).alias("v"))
    for low, high in RANGES:
        out = F.when((code >= low) & (code <= high), F.struct(F.lit(-low).alias("o"), F.lit(high - low + 1).alias("r"), (code - low).alias("v"))).otherwise(out)
    offset = 0
    inside = None
    for own in KINDS:
        this = F.struct(F.lit(offset).alias("o"), F.lit(len(own)).alias("r"), (place - offset).alias("v"))
        below = place < offset + len(own)
        inside = F.when(below, this) if inside is None else inside.when(below, this)
        offset += len(own)
    return F.when(place >= 0, inside).otherwise(out)


def _written(symbol: Column, v: Column) -> Column:
    ranged = F.decode(F.unhex(F.lpad(F.hex((v - symbol["o"]).cast("long")), 4, "0")), "UTF-16BE")
    return F.when(symbol["o"] >= 0, F.substring(F.lit(SYMBOLS), symbol["o"] + v + 1, F.lit(1))).otherwise(ranged)


def _swapped(text: Column, head: Column | int, tail: Column | int, tweak: Column, key: str) -> Column:
    """A lower-case ``text`` with other letters and digits of the same kinds, but for its first ``head`` and last ``tail`` ones."""
    head, tail = (x if isinstance(x, Column) else F.lit(x) for x in (head, tail))

    def body(letters: Column) -> Column:
        n = F.size(letters)
        symbols = F.transform(letters, lambda c, i: F.when((i >= head) & (i < n - tail), _symbol(c)).otherwise(F.struct(F.lit(0).alias("o"), F.lit(1).alias("r"), F.lit(0).alias("v"))))
        return _let(symbols, lambda s: _let(F.filter(s, lambda x: x["r"] > 1), lambda free: written(letters, s, free)))

    def written(letters: Column, symbols: Column, free: Column) -> Column:
        shape = F.array_join(F.zip_with(letters, symbols, lambda c, s: F.when(s["r"] > 1, F.concat(F.lit("\x1f"), s["o"].cast("string"))).otherwise(c)), "\x1e")
        new = permuted(F.transform(free, lambda x: x["v"]), F.transform(free, lambda x: x["r"]), F.concat_ws(":", tweak, shape), key)
        start = F.struct(F.lit(0).alias("j"), F.lit("").alias("out"))

        def placed(values: Column) -> Column:
            def step(acc: Column, x: Column) -> Column:
                own = x["s"]["r"] > 1
                letter = F.when(own, _written(x["s"], values[acc["j"]])).otherwise(x["c"])
                return F.struct((acc["j"] + own.cast("int")).alias("j"), F.concat(acc["out"], letter).alias("out"))

            return F.aggregate(F.zip_with(letters, symbols, lambda c, s: F.struct(c.alias("c"), s.alias("s"))), start, step, lambda acc: acc["out"])

        return F.when(F.size(free) > 0, _let(new, placed)).otherwise(F.array_join(letters, ""))

    return _let(_letters(text), body)


def _cased(new: Column, like: Column) -> Column:
    """``new`` with capitals where ``like`` has them."""
    pair = lambda a, b: F.when((b != F.lower(b)) & (F.length(F.upper(a)) == 1), F.upper(a)).otherwise(a)
    return F.array_join(F.zip_with(_letters(new), _letters(like), pair), "")


def _spaced(new: Column, like: Column) -> Column:
    """The symbols of ``new`` in the places of ``like``'s letters and digits."""
    start = F.struct(F.lit(0).alias("j"), F.lit("").alias("out"))

    def step(acc: Column, c: Column) -> Column:
        own = c.rlike("[0-9A-Za-z]")
        letter = F.when(own, F.substring(new, acc["j"] + 1, F.lit(1))).otherwise(c)
        return F.struct((acc["j"] + own.cast("int")).alias("j"), F.concat(acc["out"], letter).alias("out"))

    return F.aggregate(_letters(like), start, step, lambda acc: acc["out"])


def surrogate(entity: Column, key: str) -> Column:
    """What replaces an entity, or null where it stays."""
    if not key:
        raise ValueError("surrogates need a secret key")
    low, digits, compact = _lower(entity), F.regexp_replace(entity, "[^0-9]", ""), F.regexp_replace(entity, "[^0-9A-Za-z]", "")
    domain = F.substring_index(low, "@", -1)
    site, ending = F.regexp_extract(domain, r"^(.*)\.[^.]*$", 1), F.substring_index(domain, ".", -1)
    local = _swapped(F.substring_index(low, "@", 1), 0, 0, F.concat(F.lit("mail:"), domain), key)
    mail = _cased(F.concat(local, F.lit("@"), _swapped(site, 0, 0, F.concat(F.lit("domain:"), ending), key), F.lit("."), ending), entity)

    octets = F.transform(F.split(entity, r"\."), lambda o: o.cast("int"))
    usual = (octets[0] >= 1) & (octets[0] <= 223)
    first = F.when(usual, octets[0] - 1).when(octets[0] == 0, 0).otherwise(octets[0] - 223)
    radix = F.array(F.when(usual, 223).otherwise(33), F.lit(256), F.lit(256), F.lit(256))
    new = permuted(F.array(first, octets[1], octets[2], octets[3]), radix, F.concat(F.lit("address:"), usual.cast("string")), key)
    back = lambda v: F.when(usual, v + 1).when(v == 0, 0).otherwise(v + 223)
    address = F.array_join(F.transform(new, lambda v, i: F.when(i == 0, back(v)).otherwise(v).cast("string")), ".")

    hexes = _letters(F.regexp_replace(low, ":", ""))
    values = permuted(F.transform(hexes, lambda c: F.instr(F.lit("0123456789abcdef"), c) - 1), F.transform(hexes, lambda c: F.lit(16)), F.concat(F.lit("address6:"), F.regexp_replace(low, "[^:]", "x")), key)
    address6 = _cased(_spaced(F.array_join(F.transform(values, lambda v: F.substring(F.lit("0123456789abcdef"), v + 1, F.lit(1))), ""), low), F.when(entity.rlike("[A-F]"), F.upper(entity)).otherwise(entity))
    address6 = F.when(entity.rlike("[A-F]"), F.upper(address6)).otherwise(address6)

    body = _swapped(digits, 1, 1, F.lit("card"), key)
    checked = lambda b: F.concat(F.substring(b, F.lit(1), F.length(b) - 1), ((10 - luhn_total(F.concat(F.substring(b, F.lit(1), F.length(b) - 1), F.lit("0"))) % 10) % 10).cast("string"))
    card = _spaced(_let(body, checked), entity)

    account = F.upper(_swapped(F.lower(F.substr(compact, F.lit(5))), 0, 0, F.concat(F.lit("iban:"), F.substring(compact, 1, 2)), key))
    land = F.substring(compact, 1, 2)
    iban = _spaced(_let(account, lambda a: F.concat(land, F.lpad((98 - iban_rest(F.concat(land, F.lit("00"), a))).cast("string"), 2, "0"), a)), entity)

    abroad = entity.startswith("+")
    country = F.when(digits.rlike("^[17]"), 1).when(digits.rlike(f"^(?:{TWO_DIGITS})"), 2).otherwise(3)
    head = F.when(abroad, country).when(digits.startswith("0"), 1).otherwise(0)
    phone = _spaced(_swapped(digits, head, 0, F.concat(F.lit("phone:"), abroad.cast("string"), F.substring(digits, F.lit(1), head)), key), entity)

    def word(w: Column) -> Column:
        small = _lower(w)
        tail = F.when(F.length(w) > 2, F.length(F.regexp_extract(small, ENDING, 0))).otherwise(0)
        tail = F.least(tail, F.length(w) - 2)
        keeps = w.rlike(f"^(?:(?:{TITLES})\\.?|{PARTICLES})$")
        return F.when(keeps, w).otherwise(_cased(_swapped(small, 0, F.greatest(tail, F.lit(0)), F.lit("name"), key), w))

    name = F.array_join(F.transform(F.split(entity, " "), word), " ")
    return _let(
        kind(entity),
        lambda k: F.when(k == "mail", mail).when(k == "address", address).when(k == "address6", address6).when(k == "card", card).when(k == "iban", iban).when(k == "phone", phone).when(k == "name", name),
    )


def canonical(entity: Column) -> Column:
    """The form by which entities are the same: of numbers their letters and digits, of names without title, all in lower case."""
    def body(e: Column) -> Column:
        form = lambda k: (
            F.when(k.isin("card", "iban"), F.lower(F.regexp_replace(e, "[^0-9A-Za-z]", ""))).when(k == "phone", F.regexp_replace(e, "[^0-9+]", ""))
            .when(k == "name", _lower(F.regexp_replace(e, rf"^(?:(?:{TITLES})\.?\x20){{1,2}}", ""))).otherwise(_lower(e))
        )
        return _let(kind(e), form)

    return _let(entity, body)


def collisions(docs: DataFrame, key: str) -> DataFrame:
    """(kind, surrogate, n): surrogates that n > 1 different entities of the corpus share, and those that are what they
    replace (n = 1). None, unless the permutation is broken: a check of the whole corpus."""
    each = docs.where(F.col("text").rlike(MIGHT)).select(F.explode(found(F.col("text"))).alias("e")).distinct()
    pairs = each.select(kind(F.col("e")).alias("kind"), canonical(F.col("e")).alias("old"), canonical(surrogate(F.col("e"), key)).alias("surrogate")).where("kind is not null")
    return pairs.groupBy("kind", "surrogate").agg(F.count_distinct("old").alias("n"), F.max(F.col("old") == F.col("surrogate")).alias("same")).where("n > 1 or same").drop("same")


def replaced(docs: DataFrame, key: str, count: str | None = "n_entities") -> DataFrame:
    """``docs`` with surrogates for entities, and ``count``, the number of places replaced, instead of any such column."""
    names = [c for c in docs.columns if c != count]
    text = F.col("text")

    def rewritten(entities: Column) -> Column:
        new = F.transform(entities, lambda e: _let(surrogate(e, key), lambda s: F.struct(F.coalesce(s, e).alias("new"), s.isNotNull().cast("long").alias("hit"))))
        joined = lambda p: F.array_join(F.zip_with(F.split(text, ENTITY, -1), p, lambda a, b: F.concat(a, F.coalesce(b["new"], F.lit("")))), "")
        return _let(new, lambda p: F.struct(joined(p).alias("text"), F.aggregate(p, F.lit(0).cast("long"), lambda a, x: a + x["hit"]).alias("n")))

    as_is = F.struct(text.alias("text"), F.lit(0).cast("long").alias("n"))
    some = _let(found(text), lambda e: F.when(F.size(e) > 0, rewritten(e)).otherwise(as_is))
    done = docs.select(F.struct(*names).alias("row"), F.when(text.rlike(MIGHT), some).otherwise(as_is).alias("done"))
    old = F.col("row.text")

    def column(c: str) -> Column:
        if c == "text":
            return F.col("done.text").alias(c)
        if c == "n_chars":
            return F.when(F.col("row.n_chars") == F.length(old), F.length("done.text").cast(docs.schema[c].dataType)).otherwise(F.col("row.n_chars")).alias(c)
        return F.col("row").getField(c).alias(c)

    return done.select(*map(column, names), *([F.col("done.n").alias(count)] if count else []))
