"""Personal data: keyed, type-consistent surrogates, in SQL functions only.

Entities are e-mail addresses, IPv4 and IPv6 addresses, phone numbers, payment card
numbers, IBANs, US social security numbers, and names after a title.  Mentions of an entity
are normalised (case, spacing, punctuation, country and trunk prefix, compressed zeros), and
the normalised value is what gets a surrogate, so all its mentions in the whole
corpus refer to one surrogate.

A name after a title is up to four words with hyphens, apostrophes, initials and particles, and
is taken apart: what stands before a particle is given names; without one the last word is the
surname, of four words the last two.  Each word of a surname is an entity of its own, so
``Mr Miller``, ``Dr. Miller`` and ``Mr John Miller`` share a surname's surrogate.  Given names are
an entity together with gender and surname.  Initials and particles stay.

A full name or a surname that stands after a title somewhere in a document is replaced in the rest
of the document too where it has the same letters, without a title or after one that tells no
gender (Dr, Prof); there a full name takes the surrogate of the mention that tells it, of several
the first by value.  Names that stand after no title in a document aren't found.

Surrogates come from SHA-512 of key, type, value and attempt:

* e-mail: each letter a letter, each digit a digit, the rest and the top-level
  domain as they are; the case of each character follows the mention;
* phone, card and social security number: digits only change, in the mention's own punctuation;
  a card number that satisfies the Luhn check keeps satisfying it;
* IBAN: country, letters and digits stay what they are; one with right check digits gets right ones;
* IPv4: four octets from 1 to 254; IPv6: hex digits, groups of zero and leading zeros stay;
* name: given names of the title's gender, as many as the mention has, and surnames of syllables, in the
  mention's script, capitalised and joined like it.

Collision checks: a surrogate must differ from all other surrogates of its type
and from every real value of its type in the corpus
(a given name: from those with the same surname, so full names stay distinct).  Values that fail take the
next attempt (of equal surrogates the smallest value stays), until none fail.  Later attempts
have more room, so this ends: a longer local part or name, and from attempt ``ROOMY`` on
more digits behind a number or address.

Null texts stay null, empty ones empty.  Texts without entities are untouched and
aren't shuffled.  Long texts are read as a whole.  Repeated rows and rows with a null id are masked
like all others; rows are told apart by id and text, so those without an id are spread.
Other columns are kept.  An empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chomeflow.llm.tables import Scratch, free_name

#: For tests and examples; production passes its own.
DEMONSTRATION_KEY = "demonstration key"

#: From this attempt on surrogates of a fixed length get longer.
ROOMY = 24

#: Titles with the gender that they tell; the last tell none.
FEMALE_TITLES = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа", "Г-жа"]
MALE_TITLES = ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин", "Г-н"]
OTHER_TITLES = ["Dr", "Prof"]

#: Small words inside surnames.
PARTICLES = ["von", "van", "de", "der", "den", "del", "della", "di", "da", "dos", "du", "la", "le", "ten", "ter", "zu", "zum", "al", "el", "bin", "ibn"]

#: Country calling codes of one and of two digits; all others have three.
CALLING_1 = ["1", "7"]
CALLING_2 = ["20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56", "57", "58"]
CALLING_2 += ["60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98"]

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})*\.[A-Za-z]{2,24}(?![A-Za-z0-9])"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
IPV4 = rf"(?<![0-9A-Za-z.]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9A-Za-z]|\.[0-9])"
_HEX = "[0-9A-Fa-f]{1,4}"
IPV6 = rf"(?<![0-9A-Za-z:.])(?:{_HEX}(?::{_HEX}){{7}}|{_HEX}(?::{_HEX}){{0,5}}::{_HEX}(?::{_HEX}){{0,5}})(?![0-9A-Za-z:])"
PHONE = (
    r"\+[0-9]{1,3}[ -]?\(?[0-9]{2,4}\)?[ -]?[0-9]{3,4}[ -]?[0-9]{3,4}(?![0-9])|(?<![0-9A-Za-z])\(?[0-9]{3}\)?[ -][0-9]{3}-[0-9]{4}(?![0-9A-Za-z])"
    r"|(?<![0-9A-Za-z])0[0-9]{1,4}[ -][0-9]{3,4}[ -][0-9]{3,4}(?![0-9A-Za-z])"
)
CARD = r"(?<![0-9A-Za-z])(?:[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{1,7}|[0-9]{13,19})(?![0-9A-Za-z])"
IBAN = r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?|[A-Z0-9]{11,30})(?![0-9A-Za-z])"
SSN = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"
_TITLE = "(?:" + "|".join(FEMALE_TITLES + MALE_TITLES + OTHER_TITLES) + ")"
_PARTICLES = "(?:(?:" + "|".join(PARTICLES) + ") ){0,3}"
_INITIAL = r"\p{Lu}\."
_WORD = rf"(?!{_TITLE}(?!\p{{L}}))\p{{Lu}}(?:['’]\p{{L}})?[\p{{L}}\p{{M}}]+(?:['’-]\p{{L}}[\p{{L}}\p{{M}}]+)*"
NAME = rf"(?<![\p{{L}}]){_TITLE}\.? (?:{_INITIAL} ?){{0,3}}{_PARTICLES}{_WORD}(?:(?: {_INITIAL})? {_PARTICLES}{_WORD}){{0,3}}"
KINDS = {"email": EMAIL, "ipv4": IPV4, "ipv6": IPV6, "iban": IBAN, "ssn": SSN, "phone": PHONE, "card": CARD, "name": NAME}
ANY = "|".join(f"(?:{p})" for p in KINDS.values())
#: What every entity contains; texts without it need no closer look.
HINT = "[0-9@:]|" + _TITLE

#: Given names by script and gender, and syllables of surnames.
GIVEN = {
    ("latin", "f"): ["Alma", "Berta", "Carla", "Delia", "Edith", "Flora", "Greta", "Hilda", "Irene", "Julia", "Klara", "Lydia", "Marta", "Nora", "Olga", "Paula"],
    ("latin", "m"): ["Albert", "Bruno", "Carlo", "Dario", "Edgar", "Felix", "Georg", "Hugo", "Ivo", "Jonas", "Karl", "Leo", "Marco", "Nils", "Oskar", "Paul"],
    ("latin", "n"): ["Alex", "Chris", "Jamie", "Kim", "Luca", "Robin", "Sascha", "Toni"],
    ("cyrillic", "f"): ["Анна", "Вера", "Галина", "Дарья", "Елена", "Зоя", "Ирина", "Лидия"],
    ("cyrillic", "m"): ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Лев"],
    ("cyrillic", "n"): ["Валя", "Женя", "Саша", "Шура"],
}
SYLLABLES = {
    "latin": ["ba", "de", "fi", "go", "hu", "ka", "le", "mi", "no", "ru", "sa", "te", "vi", "wo", "zu", "na"],
    "cyrillic": ["ба", "де", "фи", "го", "ху", "ка", "ле", "ми", "но", "ру", "са", "те", "ви", "во", "зу", "на"],
}


def _full(c: Column, pattern: str) -> Column:
    return c.rlike(f"^(?:{pattern})$")


def kind_of(mention: Column) -> Column:
    kind = F.lit("name")
    for name, pattern in reversed(KINDS.items()):
        kind = F.when(_full(mention, pattern), name).otherwise(kind)
    return kind


def digits_of(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _untitled(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{_TITLE}\.? ", "")


def _gender(c: Column) -> Column:
    told = lambda titles: c.rlike("^(?:" + "|".join(titles) + r")\.? ")
    return F.when(told(FEMALE_TITLES), "f").when(told(MALE_TITLES), "m").otherwise("n")


def _script(c: Column) -> Column:
    return F.when(c.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")


def _given_and_surname(bare: Column) -> tuple[Column, Column]:
    """The given names (may be empty) and the surname of a name without its title."""
    words = F.split(bare, " ")
    particle = F.array_position(F.transform(words, lambda w: w.isin(PARTICLES)), True).cast("int")
    n = (
        F.when(particle > 0, particle - 1).when(F.size(words) == 1, 0)
        .when((F.size(words) == 4) & ~F.element_at(words, -2).endswith("."), 2).otherwise(F.size(words) - 1)
    )
    return F.array_join(F.slice(words, F.lit(1), n), " "), F.array_join(F.slice(words, n + 1, F.size(words)), " ")


def _tokens(phrase: Column) -> Column:
    """Runs of letters, and what stands between them."""
    return F.regexp_extract_all(phrase, F.lit(r"[\p{L}\p{M}]+|[^\p{L}\p{M}]+"), F.lit(0))


def _replaced(token: Column) -> Column:
    """Whether a token of a name is replaced: initials, particles and marks stay."""
    return (F.length(token) > 1) & token.rlike(r"^\p{L}") & ~token.isin(PARTICLES)


def _given_value(gender: Column, given: Column, surname: Column) -> Column:
    words = F.array_join(F.filter(_tokens(given), _replaced), " ")
    return F.when(words != "", F.concat_ws("|", gender, _script(given), F.lower(words), F.lower(surname)))


def _surname_value(token: Column) -> Column:
    return F.concat_ws("|", _script(token), F.lower(token))


def entities(mention: Column) -> Column:
    """(kind, value) of all that a mention holds: one, but for names their given names and each word of the surname."""
    kind = kind_of(mention)
    entity = lambda k, v: F.struct(k.alias("kind"), v.alias("value"))
    given, surname = _given_and_surname(_untitled(mention))
    first = F.filter(F.array(entity(F.lit("given"), _given_value(_gender(mention), given, surname))), lambda e: e["value"].isNotNull())
    rest = F.transform(F.filter(_tokens(surname), _replaced), lambda t: entity(F.lit("surname"), _surname_value(t)))
    return F.when(kind == "name", F.array_distinct(F.concat(first, rest))).otherwise(F.array(entity(kind, normal(mention, kind))))


def _national(mention: Column) -> Column:
    """The digits of a phone number without country and trunk prefix."""
    d = digits_of(mention)
    code = F.when(F.substring(d, 1, 1).isin(CALLING_1), 1).when(F.substring(d, 1, 2).isin(CALLING_2), 2).otherwise(3)
    plain = F.when((F.length(d) == 11) & d.startswith("1"), F.substring(d, 2, 10)).otherwise(d)
    bare = F.when(mention.startswith("+"), F.substr(d, code + 1, F.length(d))).otherwise(plain)
    return F.when(F.length(bare) > 6, F.regexp_replace(bare, "^0", "")).otherwise(d)


def _groups(mention: Column) -> Column:
    """The eight groups of an IPv6 address, four hex digits each."""
    side = lambda i: F.split(F.substring_index(F.lower(mention), "::", i), ":")
    gap = F.array_repeat(F.lit("0"), F.lit(8) - F.size(side(1)) - F.size(side(-1)))
    return F.transform(F.when(mention.contains("::"), F.concat(side(1), gap, side(-1))).otherwise(side(1)), lambda g: F.lpad(g, 4, "0"))


def normal(mention: Column, kind: Column) -> Column:
    """The value that mentions of an entity share, but for names."""
    d = digits_of(mention)
    return (
        F.when(kind == "email", F.lower(mention))
        .when(kind == "ipv4", mention)
        .when(kind == "ipv6", F.array_join(_groups(mention), ":"))
        .when(kind == "iban", F.replace(mention, F.lit(" "), F.lit("")))
        .when(kind == "phone", _national(mention))
        .when(kind.isin("card", "ssn"), d)
    )


def _mod97(iban: Column) -> Column:
    """The remainder of an IBAN, its first four characters moved to the end and letters counted from 10."""
    moved = F.concat(F.substr(iban, F.lit(5), F.length(iban)), F.substr(iban, F.lit(1), F.lit(4)))
    value = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    each = F.transform(F.sequence(F.lit(1), F.length(moved)), lambda i: value(F.substr(moved, i, F.lit(1))))
    return F.aggregate(each, F.lit(0), lambda a, x: (a * F.when(x > 9, 100).otherwise(10) + x) % 97)


def _luhn(digits: Column) -> Column:
    """The Luhn sum mod 10 of a string of digits."""
    n = F.length(digits)
    each = F.transform(
        F.sequence(F.lit(1), n),
        lambda i: F.when((n - i) % 2 == 1, F.element_at(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), F.substr(digits, i, F.lit(1)).cast("int") + 1)).otherwise(
            F.substr(digits, i, F.lit(1)).cast("int")
        ),
    )
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10


def _byte(digest: Column, i: Column) -> Column:
    """The i-th byte (from 0, wrapping round) of a hex digest."""
    return F.conv(F.substr(digest, (i % 64) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def surrogate(kind: Column, value: Column, attempt: Column, key: str) -> Column:
    digest = F.sha2(F.concat_ws("\x1f", F.lit(key), kind, value, attempt.cast("string")).cast("binary"), 512)
    chars = F.sequence(F.lit(0), F.length(value) - 1)
    letter = lambda i: F.chr(F.lit(97) + _byte(digest, i) % 26)
    digit = lambda i: (_byte(digest, i) % 10).cast("string")
    own = lambda i: F.substr(value, i + 1, F.lit(1))

    def joined(each, places: Column = chars) -> Column:
        return F.array_join(F.transform(places, each), "")

    def more(n: Column, each) -> Column:
        """n more characters, none for n of 0."""
        return F.when(n > 0, joined(lambda i: each(i + 23), F.sequence(F.lit(1), F.greatest(n, F.lit(1))))).otherwise("")

    late = F.greatest(attempt - (ROOMY - 1), F.lit(0))
    alike = joined(lambda i: F.when(own(i).rlike("[a-z]"), letter(i)).when(own(i).rlike("[0-9]"), digit(i)).otherwise(own(i)))
    top = F.length(value) - F.length(F.substring_index(value, ".", -1))
    at = F.locate("@", value)
    email = F.concat(F.substr(alike, F.lit(1), at - 1), more(attempt, letter), F.substr(alike, at, top - at + 1), F.substr(value, top + 1, F.length(value)))
    number = F.concat(joined(digit), more(late, digit))
    body = F.substr(number, F.lit(1), F.length(number) - 1)
    checked = F.concat(body, ((10 - _luhn(F.concat(body, F.lit("0")))) % 10).cast("string"))
    card = F.when(_luhn(value) == 0, checked).otherwise(number)
    ipv4 = F.concat(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (_byte(digest, i) % 254 + 1).cast("string")), "."), F.when(late > 0, ":").otherwise(""), more(late, digit))
    # a hex digit stays zero where only zeros stand before it in its group
    hex_ = lambda i: F.lower(F.hex(_byte(digest, i) % 15 + 1))
    ahead = lambda i: F.substr(value, i - i % 5 + 1, i % 5 + 1)
    ipv6 = F.concat(joined(lambda i: F.when((own(i) == ":") | ahead(i).rlike("^0+$"), own(i)).otherwise(hex_(i))), F.when(late > 0, "%").otherwise(""), more(late, digit))
    plain = joined(lambda i: F.when(i < 2, own(i)).when(own(i).rlike("[A-Z]"), F.upper(letter(i))).otherwise(digit(i)))
    plain = F.concat(plain, more(late, digit))
    head, rest = F.substr(plain, F.lit(1), F.lit(2)), F.substr(plain, F.lit(5), F.length(plain))
    iban = F.when(_mod97(value) == 1, F.concat(head, F.lpad((98 - _mod97(F.concat(head, F.lit("00"), rest))).cast("string"), 2, "0"), rest)).otherwise(plain)
    part = lambda i: F.try_element_at(F.split(value, r"\|"), F.lit(i))

    def pick(options: list[str], i: Column) -> Column:
        return F.element_at(F.array(*[F.lit(x.lower()) for x in options]), _byte(digest, i) % len(options) + 1)

    def syllables(script: Column, n: Column, first: Column) -> Column:
        each = lambda i: F.when(script == "cyrillic", pick(SYLLABLES["cyrillic"], first + i)).otherwise(pick(SYLLABLES["latin"], first + i))
        return F.when(n > 0, joined(each, F.sequence(F.lit(1), F.greatest(n, F.lit(1))))).otherwise("")

    def given(i: Column) -> Column:
        name = F.lit(None).cast("string")
        for (script, gender), names in GIVEN.items():
            name = F.when((part(2) == script) & (part(1) == gender), pick(names, i)).otherwise(name)
        return name

    # later attempts have longer names, so there are always enough
    n_words = F.size(F.split(part(3), " "))
    all_given = F.concat(F.array_join(F.transform(F.sequence(F.lit(1), n_words), given), " "), syllables(part(2), attempt, n_words))
    given_names = F.concat_ws("|", part(1), part(2), all_given, part(4))
    surname = F.concat_ws("|", part(1), syllables(part(1), attempt + 4, F.lit(0)))
    return (
        F.when(kind == "email", email).when(kind == "ipv4", ipv4).when(kind == "ipv6", ipv6).when(kind == "iban", iban)
        .when(kind.isin("phone", "ssn"), number).when(kind == "card", card).when(kind == "given", given_names).otherwise(surname)
    )


def _cased(like: Column, new: Column) -> Column:
    """``new`` with upper case where ``like`` has it; what is longer stays."""
    at = lambda c, i: F.substr(c, i, F.lit(1))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(new)), lambda i: F.when(at(like, i).rlike(r"\p{Lu}"), F.upper(at(new, i))).otherwise(at(new, i))), "")


def _name_shown(mention: Column, news: Column) -> tuple[Column, Column]:
    """The given names and the surname of a name's mention in surrogates, of a map from "kind|value" to surrogate."""
    given, surname = _given_and_surname(_untitled(mention))
    new = lambda kind, value, i: F.try_element_at(F.split(F.try_element_at(news, F.concat_ws("|", F.lit(kind), value)), r"\|"), F.lit(i))
    like = lambda t, word: F.when(t == F.upper(t), F.upper(word)).otherwise(F.initcap(word))
    tokens, words = _tokens(given), F.split(new("given", _given_value(_gender(mention), given, surname), 3), " ")
    nth = lambda i: F.size(F.filter(F.slice(tokens, F.lit(1), i + 1), _replaced)) - 1
    given = F.array_join(F.transform(tokens, lambda t, i: F.when(_replaced(t), like(t, F.get(words, nth(i)))).otherwise(t)), "")
    surname = F.array_join(F.transform(_tokens(surname), lambda t: F.when(_replaced(t), like(t, new("surname", _surname_value(t), 2))).otherwise(t)), "")
    return given, surname


def _title(mention: Column) -> Column:
    return F.substr(mention, F.lit(1), F.length(mention) - F.length(_untitled(mention)))


def rendered(mention: Column, kind: Column, value: Column, new: Column, news: Column) -> Column:
    """A surrogate in the format of one mention; for a name of all ``news`` of its parts."""
    places = F.sequence(F.lit(1), F.length(mention))
    at = lambda c, i: F.substr(c, i, F.lit(1))
    part = lambda c, i: F.substring_index(c, "@", i)
    email = F.concat(_cased(part(mention, 1), part(new, 1)), F.lit("@"), _cased(part(mention, -1), part(new, -1)))
    # digits before the normalised ones (a country prefix) stay; what is longer than the mention follows it
    digits = digits_of(mention)
    ahead = F.length(digits) - F.length(value)
    kept = F.concat(F.substr(digits, F.lit(1), ahead), new)
    seen = lambda i: F.length(digits_of(F.substr(mention, F.lit(1), i)))
    filled = F.array_join(F.transform(places, lambda i: F.when(at(mention, i).rlike("[0-9]"), at(kept, seen(i))).otherwise(at(mention, i))), "")
    filled = F.concat(filled, F.substr(kept, F.length(digits) + 1, F.length(kept)))
    shown = lambda i: F.length(F.replace(F.substr(mention, F.lit(1), i), F.lit(" "), F.lit("")))
    spaced = F.array_join(F.transform(places, lambda i: F.when(at(mention, i) == " ", F.lit(" ")).otherwise(at(new, shown(i)))), "")
    spaced = F.concat(spaced, F.substr(new, F.length(value) + 1, F.length(new)))
    side = lambda i: F.split(F.substring_index(mention, "::", i), ":")
    group = lambda i: F.element_at(F.split(F.substring_index(new, "%", 1), ":"), i)
    like = lambda groups, first: F.array_join(F.transform(groups, lambda g, i: F.right(group(first + i), F.length(g))), ":")
    ipv6 = F.when(mention.contains("::"), F.concat(like(side(1), 1), F.lit("::"), like(side(-1), 9 - F.size(side(-1))))).otherwise(like(side(1), 1))
    ipv6 = F.concat(F.when(mention.rlike("[A-F]"), F.upper(ipv6)).otherwise(ipv6), F.substr(new, F.length(value) + 1, F.length(new)))
    given, surname = _name_shown(mention, news)
    name = F.concat(_title(mention), given, F.when(given != "", " ").otherwise(""), surname)
    return (
        F.when(kind == "email", email).when(kind == "ipv4", new).when(kind == "ipv6", ipv6).when(kind == "iban", spaced)
        .when(kind.isin("phone", "card", "ssn"), filled).otherwise(name)
    )


def mentions(text: Column) -> Column:
    """All mentions in a text, in order."""
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))


def resolved(values: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    """(kind, value, surrogate) of distinct (kind, value), after collision checks."""
    now = scratch.save(values.select("kind", "value", F.lit(0).alias("attempt"), surrogate(F.col("kind"), F.col("value"), F.lit(0), key).alias("surrogate")), "surrogates")
    while True:
        first = now.groupBy("kind", "surrogate").agg(F.min("value").alias("holder"), F.count("*").alias("n"))
        real = now.select("kind", F.col("value").alias("surrogate"), F.lit(True).alias("real"))
        taken = first.join(real, ["kind", "surrogate"], "left").where("n > 1 OR real")
        taken = scratch.save(taken.select("kind", "surrogate", F.when(F.col("real").isNull(), F.col("holder")).alias("holder")), "taken")
        if taken.isEmpty():
            scratch.drop(taken)
            return now
        fails = F.col("t.surrogate").isNotNull() & ~F.col("s.value").eqNullSafe(F.col("t.holder"))
        attempt = F.when(fails, F.col("s.attempt") + 1).otherwise(F.col("s.attempt"))
        joined = now.alias("s").join(taken.alias("t"), [F.col("s.kind") == F.col("t.kind"), F.col("s.surrogate") == F.col("t.surrogate")], "left")
        joined = joined.select("s.kind", "s.value", fails.alias("fails"), attempt.alias("attempt"), F.col("s.surrogate").alias("old"))
        again = joined.select("kind", "value", "attempt", F.when(F.col("fails"), surrogate(F.col("kind"), F.col("value"), F.col("attempt"), key)).otherwise(F.col("old")).alias("surrogate"))
        after = scratch.save(again, "surrogates")
        scratch.drop(now, taken)
        now = after


def _bare_names(mention: Column, news: Column) -> Column:
    """(gender, name, its surrogate) of the full name, where a mention has one, and of the surname, which comes last in order."""
    given, surname = _given_and_surname(_untitled(mention))
    new_given, new_surname = _name_shown(mention, news)
    name = lambda g, n, new: F.struct(g.alias("gender"), n.alias("name"), new.alias("shown"))
    full = name(_gender(mention), _untitled(mention), F.concat_ws(" ", new_given, new_surname))
    return F.filter(F.array(F.when(given != "", full), name(F.lit("~"), surname, new_surname)), lambda n: n.isNotNull())


def _alone(names: Column) -> Column:
    """A pattern of all entities and of the names, long ones first, where they stand alone."""
    by_length = F.array_sort(F.transform(F.map_keys(names), lambda n: F.struct((-F.length(n)).alias("shorter"), n.alias("name"))))
    some = F.array_join(F.transform(by_length, lambda n: F.concat(F.lit(r"\Q"), n["name"], F.lit(r"\E"))), "|")
    return F.when(F.size(names) > 0, F.concat(F.lit(ANY + r"|(?<!\p{L})(?:"), some, F.lit(r")(?![\p{L}\p{M}])"))).otherwise(ANY)


def masked(docs: DataFrame, key: str = DEMONSTRATION_KEY, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """The documents with all entities replaced; with ``count_col`` also the number of mentions of each, without names that stand alone."""
    scratch = Scratch(docs.sparkSession, "pii")
    told = F.xxhash64(text_col)
    found = docs.select(F.col(id_col).alias("_id"), told.alias("_h"), F.explode(F.array_distinct(mentions(F.col(text_col)))).alias("mention"))
    found = scratch.save(found.distinct(), "mentions")
    distinct = found.select("mention").distinct().select("mention", F.inline(entities(F.col("mention"))))
    distinct = scratch.save(distinct, "values")
    new_of = resolved(distinct.select("kind", "value").distinct(), key, scratch)
    # a mention has one entity, or the few of its name
    news = F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "kind", "value"), "surrogate"))).alias("news")
    m, is_name = F.col("mention"), F.col("kind").isin("given", "surname")
    whole = distinct.join(new_of, ["kind", "value"]).groupBy("mention").agg(F.min("kind").alias("kind"), F.min("value").alias("value"), F.min("surrogate").alias("new"), news)
    bare = F.when(is_name, _bare_names(m, F.col("news"))).otherwise(F.array())
    shown = whole.select("mention", rendered(m, F.col("kind"), F.col("value"), F.col("new"), F.col("news")).alias("shown"), bare.alias("bare"))
    shown = scratch.save(shown, "shown")
    # names that tell a gender first, so that the others follow them
    names = F.array_sort(F.array_distinct(F.flatten(F.collect_list("bare"))))
    per_doc = found.join(shown, "mention").groupBy("_id", "_h").agg(F.map_from_entries(F.collect_list(F.struct("mention", "shown"))).alias("_shown"), names.alias("_names"))
    by_name = F.aggregate(
        "_names", F.create_map().cast("map<string,string>"), lambda acc, n: F.when(F.map_contains_key(acc, n["name"]), acc).otherwise(F.map_concat(acc, F.create_map(n["name"], n["shown"])))
    )
    per_doc = scratch.save(per_doc.select("_id", "_h", "_shown", by_name.alias("_names")), "by-document")
    scratch.drop(found, distinct, new_of, shown)

    n = free_name(docs, count_col or "_n")
    has = F.coalesce(F.col(text_col).rlike(HINT) & F.col(text_col).rlike(ANY), F.lit(False))
    clean = docs.where(~has).withColumn(n, F.lit(0).cast("long"))
    own, own_h, shown_col, names_col = (free_name(docs, c) for c in ("_own_id", "_own_hash", "_own_shown", "_own_names"))
    per_doc = per_doc.withColumnsRenamed({"_id": own, "_h": own_h, "_shown": shown_col, "_names": names_col})
    with_some = docs.where(has).join(per_doc, F.col(id_col).eqNullSafe(F.col(own)) & (told == F.col(own_h)))
    bare, pattern = F.col(names_col), _alone(F.col(names_col))
    every = F.regexp_extract_all(F.col(text_col), pattern, F.lit(0))
    # a name after a title that tells no gender follows the one that does
    put = lambda m: F.coalesce(
        F.when(_gender(m) == "n", F.concat(_title(m), F.try_element_at(bare, _untitled(m)))), F.try_element_at(F.col(shown_col), m), F.try_element_at(bare, m), m
    )
    new_text = F.array_join(F.zip_with(F.split(F.col(text_col), pattern, -1), F.transform(every, put), lambda g, m: F.concat(g, F.coalesce(m, F.lit("")))), "")
    counted = F.size(F.filter(every, lambda m: F.map_contains_key(F.col(shown_col), m)))
    dirty = with_some.withColumns({text_col: new_text, n: counted.cast("long")}).select(*clean.columns)
    out = clean.unionByName(dirty)
    return out.withColumnRenamed(n, count_col) if count_col else out.drop(n)
