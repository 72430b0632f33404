"""Surrogates for personal data, in SQL functions only.

Entities are found by patterns.  Each is replaced by a surrogate of its own
type, drawn from a hash of a secret key, the entity and an attempt number: the
same length and punctuation, letters for letters and digits for digits, a valid
check digit where the type has one, names of the same gender and script.  The
same entity has the same surrogate wherever it stands, whatever its case or
punctuation, so coreference holds.  A name is an entity behind a title or a
known given name; a surname found so is followed through its text, where it
stands alone, too.  Known given names and initials go round a circle that the
key orders, so distinct ones stay distinct.  A value behind a word such as
``password`` is a secret by its make-up (a digit, or capitals within), so that
prose is left alone.

Distinct entities must have distinct surrogates, and no surrogate may be
another entity of the corpus.  All distinct entities are therefore gathered
(their strings only), and those whose surrogate is taken draw again with the
next attempt number until none is.  After every ``GROWS_AFTER`` attempts the
surrogate is a character longer, so no format runs out of them.  Attempts above
0 are rare; only they are joined back to the texts, all other surrogates are
computed on the row.
"""

from __future__ import annotations

import hashlib
import hmac
import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowmatch.llm.common import kept, text_or_empty

# Given names by gender and script.
MALE = "James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Mark Paul Steven Andrew Kenneth George Kevin Brian Edward Hans Peter Klaus Pierre Jean Carlos Juan Luis".split()
FEMALE = "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Lisa Nancy Betty Margaret Sandra Ashley Emily Donna Michelle Carol Amanda Melissa Anna Maria Julia Sophie Claire Laura Isabel Ingrid".split()
MALE_CYRILLIC = "Иван Пётр Алексей Дмитрий Сергей Андрей Михаил Николай Владимир Павел Юрий Олег".split()
FEMALE_CYRILLIC = "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана Екатерина Юлия Дарья Вера".split()
# Forms of address by gender.
MALE_TITLES = "Mr Sir Herr Señor Monsieur".split()
FEMALE_TITLES = "Mrs Ms Miss Madam Frau Señora Señorita Madame Mme Mlle".split()
OTHER_TITLES = "Dr Prof".split()
# Capital words that make a place or an institution of a given name before them.
PLACES = "Street St Road Rd Avenue Ave Lane Drive Boulevard Square Park Bridge River Lake Creek Bay Island Islands Mountain Mount Hill Hills Valley County City Town Village Station Airport Harbour Harbor University College School Hospital Church Cathedral Abbey Castle Hall House Tower Museum Library Prize Award Day Act Company Inc Ltd".split()
# Syllables of made-up surnames.
LATIN = "ba be bo da de do fa fe ga go ha he ja jo ka ke la le lo ma me mo na ne pa ra re ro sa se ta te".split()
CYRILLIC = "ба бе бо да де до фа фе га го ха хе жа жо ка ке ла ле ло ма ме мо на не па ра ре ро са се та те".split()


_KNOWN = {"male": MALE, "female": FEMALE, "male cyrillic": MALE_CYRILLIC, "female cyrillic": FEMALE_CYRILLIC}
_TITLE = rf"(?:{'|'.join(MALE_TITLES + FEMALE_TITLES + OTHER_TITLES)})"
_GIVEN = rf"(?:{'|'.join(n for names in _KNOWN.values() for n in names)})"
_WORD = r"\p{Lu}[\p{L}\p{M}'’-]{0,40}\p{Ll}"
_INITIAL = r"\p{Lu}\."
_SURNAME = rf"(?!(?:{'|'.join(PLACES)})(?!\p{{L}})){_WORD}"
# IBAN lengths by country.
_IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK SA SE SK TN VG RO", 25: "LY PT ST", 26: "IS TR", 27: "FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HU LB PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC"}
_IBAN = "|".join([rf"(?:{c.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{n // 4 - 1}}}" + (rf" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") + "(?![A-Za-z0-9])"
                  for n, c in _IBAN_LENGTHS.items()] + [r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"])
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_SECRET = r"(?i:password|passwd|pwd|secret|token|api[_-]?key)[\"']?[ \t]{0,3}[=:][ \t]{0,3}[\"']?"
# Digits, or a capital after a small letter, as generated secrets have them: "required" is none.
_MADE_UP = r"(?=[A-Za-z+/_.~-]*+[0-9]|[A-Za-z]*?[a-z][A-Z])"
# How the keys of well-known services begin.
_TOKEN_HEAD = r"(?:gh[pousr]_|github_pat_|glpat-|xox[abprs]-|[sr]k_(?:live|test)_|AIza|eyJ(?=[A-Za-z0-9_-]{6,}\.eyJ))"
_PEM_HEAD, _PEM_END = r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", r"-----END [A-Z ]{0,30}PRIVATE KEY-----"
_HEX = "[0-9A-Fa-f]{1,4}"
GROWS_AFTER = 8  # attempts that a surrogate keeps its length
# In order: at one place the first that matches names the type.  Each starts
# with a check of the character before it, so no text is scanned twice.
TYPES = [
    ("email", r"(?<![\p{L}0-9._%+-])[\p{L}0-9][\p{L}0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}"),
    ("pem", rf"(?<![A-Za-z0-9]){_PEM_HEAD}[A-Za-z0-9+/=\s]{{20,}}?{_PEM_END}"),
    ("secret", rf"{_SECRET}{_MADE_UP}[A-Za-z0-9+/_.~-]{{6,}}"),  # neither prose nor the dashes of a form to fill in
    ("token", rf"(?<![A-Za-z0-9]){_TOKEN_HEAD}[A-Za-z0-9_.-]{{10,}}[A-Za-z0-9](?![A-Za-z0-9])"),
    ("aws_key", r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])"),
    ("iban", rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{_IBAN})"),
    ("ip", rf"(?<![0-9A-Za-z.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9A-Za-z]|\.[0-9])"),
    ("ipv6", rf"(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f:]*[0-9])(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{2,6}}(?::{_HEX}){{1,5}}|(?:{_HEX}:){{1,6}}(?::{_HEX}){{2,6}})(?![0-9A-Za-z:])"),
    ("card", r"(?<![0-9A-Za-z.-])(?:[0-9]{13,19}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}|[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{1,7})(?![0-9A-Za-z-])"),
    ("ssn", r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"),
    ("phone", r"(?<![0-9A-Za-z.])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,4}|\(?[0-9]{3}(?:\)[ .-]?|[ .-])[0-9]{3}[ .-][0-9]{4})(?![0-9A-Za-z])"),
    ("name", rf"(?<![\p{{L}}\p{{M}}])(?=\p{{Lu}})(?:{_TITLE}\.? (?:(?:{_WORD}|{_INITIAL}) ){{0,3}}{_WORD}|{_GIVEN} (?:{_INITIAL} ){{0,3}}(?:{_SURNAME} )?{_SURNAME})(?![\p{{L}}\p{{M}}])"),
]
# All types but secrets start where no ASCII letter or digit stands before: one
# check for all of them passes over most places of a text.
_STARTS = "|".join(f"(?:{p})" for name, p in TYPES if name != "secret")
ANY = rf"(?<![0-9A-Za-z])(?=[0-9+(\p{{L}}-])(?:{_STARTS})|(?=[aApPsStT])(?:{dict(TYPES)['secret']})"


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often it is used."""
    return F.transform(F.array(value), body)[0]


def _byte(h: Column, i) -> Column:
    """The i-th byte of a hash of 64 bytes in hexadecimal digits."""
    return F.conv(F.substring(h, F.pmod(F.lit(i) if isinstance(i, int) else i, F.lit(64)) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _letter(first: int, among: int, b: Column) -> Column:
    return F.chr(F.lit(first) + b % among)


def _alike(text: Column, h: Column, hexadecimal: Column | None = None) -> Column:
    """Digits for digits, letters for letters of the same case, the rest kept."""
    among = F.lit(26) if hexadecimal is None else F.when(hexadecimal, 6).otherwise(26)
    return F.array_join(F.transform(F.split(text, ""), lambda c, i: F.when(c.rlike("[0-9]"), _letter(48, 10, _byte(h, i))).when(
        c.rlike(r"\p{Ll}"), _letter(97, among, _byte(h, i))).when(c.rlike(r"\p{Lu}"), _letter(65, among, _byte(h, i))).otherwise(c)), "")


def _luhn(digits: Column, first: int) -> Column:
    """Luhn sum of digits; the last one has weight ``first`` (1 or 2), then in turn."""
    def value(c, i):
        d = F.when(c == "", 0).otherwise(F.ascii(c) - 48)
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.when((i + first) % 2 == 0, twice).otherwise(d)
    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), value), F.lit(0), lambda total, d: total + d)


def _mod_97(iban: Column) -> Column:
    """ISO 7064 remainder of a compact IBAN."""
    turned = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, F.lit(1), F.lit(4)))
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda r, c: F.when(c == "", r).when(
        c.rlike("[0-9]"), (r * 10 + F.ascii(c) - 48) % 97).otherwise((r * 100 + F.ascii(c) - 55) % 97))


def _type(value: Column) -> Column:
    out = F.when(F.lit(False), "")
    for name, pattern in TYPES:
        out = out.when(value.rlike(rf"\A(?:{pattern})\z"), name)
    return out


def _compact(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9A-Z]", "")


def _valid(e: Column) -> Column:
    """Whether an entity's check digits hold; numbers that fail are no entities."""
    return F.when(e["type"] == "card", _luhn(_compact(e["value"]), 1) % 10 == 0).when(
        e["type"] == "iban", _mod_97(_compact(e["value"])) == 1).otherwise(F.lit(True))


def _is_given(word: Column) -> Column:
    return word.rlike(rf"\A{_GIVEN}\z")


def _is_title(word: Column) -> Column:
    return word.rlike(rf"\A{_TITLE}\.?\z")


def _is_initial(word: Column) -> Column:
    return word.rlike(rf"\A{_INITIAL}\z")


def _norms(e: Column) -> Column:
    """What an entity is known by, whatever its case and punctuation: one
    string, or for a name one for each word that isn't a title, initial or known name."""
    value, kind = e["value"], e["type"]
    return F.when(kind == "name", F.filter(F.split(value, " "), lambda w: ~_is_title(w) & ~_is_given(w) & ~_is_initial(w))).otherwise(F.array(
        F.when(kind.isin("email", "ipv6"), F.lower(value)).when(kind == "secret", F.regexp_replace(value, rf"\A{_SECRET}", ""))
        .when(kind == "phone", F.substring(F.regexp_replace(value, r"\A\+[0-9]{1,3}(?=[ .(-])|[^0-9]", ""), -10, 10))
        .when(kind.isin("card", "ssn", "iban"), _compact(value)).otherwise(value)))


def _syllables(word: Column, h: Column, attempt: Column) -> Column:
    """A made-up surname in the word's script; the more attempts, the longer."""
    def made(syllables, ending):
        parts = F.transform(F.sequence(F.lit(0), F.lit(2) + attempt), lambda i: F.element_at(F.lit(syllables), _byte(h, i) % len(syllables) + 1))
        return F.initcap(F.concat(F.array_join(parts, ""), ending))
    cyrillic = made(CYRILLIC, F.when(word.rlike("[ая]$"), "ва").otherwise("в"))
    return F.when(word.rlike(r"\p{IsCyrillic}"), cyrillic).otherwise(made(LATIN, F.lit("n")))


def _core(kind: Column, norm: Column, attempt: Column, key: str) -> Column:
    """The surrogate of a normalised entity, in its normal form."""
    hashed = F.sha2(F.concat_ws("|", F.lit(key), kind, norm, attempt.cast("string")), 512)
    more = F.repeat(F.lit("0"), F.floor(attempt / GROWS_AFTER).cast("int"))
    longer = F.when(kind == "email", F.concat(F.substring_index(norm, "@", 1), more, F.lit("@"), F.substring_index(norm, "@", -1))).when(
        kind == "name", norm).otherwise(F.concat(norm, more))
    longer = F.when(attempt < GROWS_AFTER, norm).otherwise(longer)
    return _let(hashed, lambda h: _let(longer, lambda n: _drawn(kind, n, attempt, key, h)))


def _drawn(kind: Column, norm: Column, attempt: Column, key: str, h: Column) -> Column:
    domain = F.substring_index(norm, "@", -1)
    labels, top = F.regexp_replace(domain, r"\.[a-z]+$", ""), F.regexp_extract(domain, r"\.[a-z]+$", 0)
    of_domain = _let(F.sha2(F.concat_ws("|", F.lit(key), F.lit("domain"), domain), 512), lambda d: _alike(labels, d))
    email = F.concat(_alike(F.substring_index(norm, "@", 1), h), F.lit("@"), of_domain, top)
    card = F.concat(F.substring(norm, 1, 1), F.substring(_alike(norm, h), F.lit(2), F.length(norm) - 2))
    card = _let(card, lambda c: F.concat(c, ((F.lit(10) - _luhn(c, 2) % 10) % 10).cast("string")))
    n = F.length(norm)
    place = lambda i: n - i  # noqa: E731  digits from the end, the last being 1
    phone = F.array_join(F.transform(F.split(norm, ""), lambda c, i: F.when(c == "", "").when(
        place(i).isin(10, 7), _letter(50, 8, _byte(h, i))).otherwise(_letter(48, 10, _byte(h, i)))), "")
    ssn = F.array_join(F.transform(F.split(norm, ""), lambda c, i: F.when(c == "", "").when(
        i == 0, _letter(49, 5, _byte(h, i))).when(i.isin(3, 5), _letter(49, 9, _byte(h, i))).otherwise(_letter(48, 10, _byte(h, i)))), "")
    iban = F.concat(F.substring(norm, 1, 2), F.lit("00"), _alike(F.substring(norm, F.lit(5), n), h))
    iban = _let(iban, lambda x: F.concat(F.substring(x, 1, 2), F.lpad((F.lit(98) - _mod_97(x)).cast("string"), 2, "0"), F.substring(x, F.lit(5), n)))
    octets = F.sequence(F.lit(0), F.lit(3) + F.floor(attempt / GROWS_AFTER).cast("int"))
    ip = F.array_join(F.transform(octets, lambda i: (_byte(h, i) % 254 + 1).cast("string")), ".")
    return (F.when(kind == "email", email).when(kind == "card", card).when(kind == "phone", phone).when(kind == "ssn", ssn)
            .when(kind == "iban", iban).when(kind == "ip", ip)
            .when(kind == "aws_key", F.concat(F.substring(norm, 1, 4), _alike(F.substring(norm, F.lit(5), n), h)))
            .when(kind == "name", _syllables(norm, h, attempt)).when(kind == "ipv6", _alike(norm, h, F.lit(True)))
            .when(kind == "token", _let(F.regexp_extract(norm, rf"\A{_TOKEN_HEAD}", 0), lambda head: F.concat(head, _alike(F.substring(norm, F.length(head) + 1, n), h))))
            .when(kind == "pem", _let(F.regexp_extract(norm, rf"\A{_PEM_HEAD}", 0), lambda head: _let(F.regexp_extract(norm, rf"{_PEM_END}", 0), lambda end: F.concat(
                head, _alike(F.substring(norm, F.length(head) + 1, n - F.length(head) - F.length(end)), h), end))))
            .otherwise(_alike(norm, h, norm.rlike(r"\A[0-9a-f]+\z"))))


def _circle(values: list[str], key: str) -> list[str]:
    """What follows each value on a circle in an order drawn by the key: distinct for distinct values, itself for none."""
    order = sorted(values, key=lambda v: hmac.new(key.encode(), v.encode(), hashlib.sha256).digest())
    after = dict(zip(order, order[1:] + order[:1]))
    return [after[v] for v in values]


def _core_of(kind: Column, norm: Column, attempts: Column, key: str) -> Column:
    attempt = F.coalesce(F.element_at(attempts, F.concat(kind, F.lit(" "), norm)), F.lit(0))
    return _let(attempt, lambda a: _core(kind, norm, a, key))


def _followed(entities: Column, pieces: Column, attempts: Column, key: str) -> Column:
    """``pieces`` of a text between its entities, with the surnames among these replaced where they stand alone."""
    names = F.array_distinct(F.flatten(F.transform(F.filter(entities, lambda e: e["type"] == "name"), _norms)))

    def replaced(piece, name):
        alone = F.concat(F.lit(r"(?<![\p{L}\p{M}'’-])"), name, F.lit(r"(?![\p{L}\p{M}]|-\p{L})"))
        return F.when(F.contains(piece, name), F.regexp_replace(piece, alone, _core_of(F.lit("name"), name, attempts, key))).otherwise(piece)
    return F.when(F.size(names) > 0, F.transform(pieces, lambda p: F.aggregate(names, p, replaced))).otherwise(pieces)


def _rendered(e: Column, attempts: Column, key: str) -> Column:
    """An entity's surrogate in the form that the entity has in the text."""
    value, kind = e["value"], e["type"]
    core_of = lambda norm: _core_of(kind, norm, attempts, key)

    def initial(w):  # another letter of its alphabet
        alphabets = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ")
        return F.translate(w, "".join(alphabets), "".join("".join(_circle(list(a), key)) for a in alphabets))

    def word(w):
        out = F.when(_is_title(w), w).when(_is_initial(w), initial(w))
        for names in _KNOWN.values():
            at = F.array_position(F.lit(names), w).cast("int")
            out = out.when(w.isin(names), F.element_at(F.lit(_circle(names, key)), at))
        return out.otherwise(core_of(w))

    def other(norm, core):
        return _laid_out(value, kind, norm, core)

    return F.when(kind == "name", F.array_join(F.transform(F.split(value, " "), word), " ")).otherwise(
        _let(_norms(e)[0], lambda norm: _let(core_of(norm), lambda core: other(norm, core))))


def _laid_out(value: Column, kind: Column, norm: Column, core: Column) -> Column:
    """A surrogate in normal form with the case and punctuation of the value."""
    more, at = F.length(core) - F.length(norm), F.instr(value, "@") - 1
    piece = lambda i: F.substring(core, F.when(i > at, i + more).otherwise(i) + 1, F.when(i == at, more + 1).otherwise(1))
    email = F.array_join(F.transform(F.split(value, ""), lambda c, i: F.when(c.rlike(r"\p{Lu}"), F.upper(piece(i))).otherwise(piece(i))), "")
    # the k-th digit or letter from the end takes the k-th of the surrogate, the
    # first one also what the surrogate is longer; a country code before them stays
    k = lambda i: F.length(F.regexp_replace(F.substring(value, i + 1, F.length(value)), "[^0-9A-Z]", ""))
    laid = F.array_join(F.transform(F.split(value, ""), lambda c, i: F.when(
        c.rlike("[0-9A-Z]") & (k(i) == F.length(norm)), F.substring(core, F.lit(1), more + 1)).when(
        c.rlike("[0-9A-Z]") & (k(i) < F.length(norm)), F.substring(core, F.length(core) - k(i) + 1, F.lit(1))).otherwise(c)), "")
    return (F.when(kind == "email", email).when(kind.isin("card", "ssn", "iban", "phone"), laid)
            .when(kind == "secret", F.concat(F.regexp_extract(value, rf"\A{_SECRET}", 0), core)).otherwise(core))


def _entities(text: Column) -> Column:
    """Entities of a text in order, with all that looked like one; ``ok`` tells which are."""
    typed = F.transform(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), lambda v: F.struct(_type(v).alias("type"), v.alias("value")))
    return F.transform(typed, lambda e: F.struct(e["type"].alias("type"), e["value"].alias("value"), _valid(e).alias("ok")))


def surrogates(docs: DataFrame, key: str, rounds: int | None = None) -> DataFrame:
    """Every distinct entity of ``docs(text, ...)`` with its surrogate:
    ``type, norm, attempt, surrogate``, distinct within a type and none of
    them an entity of the corpus.  Rounds go on until that holds; over
    ``rounds`` of them, if given, are an error.
    """
    found = docs.select(F.explode(F.filter(_entities(text_or_empty()), lambda e: e["ok"])).alias("e"))
    found = found.select("e.type", F.explode(_norms(F.col("e"))).alias("norm")).distinct()
    draw = _core(F.col("type"), F.col("norm"), F.col("attempt"), key)
    known = kept(found.withColumn("attempt", F.lit(0)).withColumn("surrogate", draw))
    for _ in itertools.count() if rounds is None else range(rounds):
        first = F.expr("row_number() over (partition by type, surrogate order by attempt, norm)")
        taken = known.select(F.col("type").alias("t"), F.col("norm").alias("taken"))
        marked = known.withColumn("turn", first).join(taken, (F.col("type") == F.col("t")) & (F.col("surrogate") == F.col("taken")), "left")
        again = (F.col("turn") > 1) | F.col("taken").isNotNull()
        marked = kept(marked.select("type", "norm", "attempt", "surrogate", again.alias("again")))
        if marked.where("again").isEmpty():
            return marked.drop("again")
        drawn = marked.where("again").select("type", "norm", (F.col("attempt") + 1).alias("attempt")).withColumn("surrogate", draw)
        known = marked.where("not again").drop("again").unionByName(drawn)
    raise RuntimeError("no distinct surrogates are left for some type")


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with surrogates for all personal data in ``text``; all columns
    and their order stay, and a text without personal data is unchanged.

    A null text stays null.  Repeated rows stay repeated; an empty table stays
    empty.  Numbers whose check digits fail are left alone.
    """
    redrawn = surrogates(docs.select("text"), key).where("attempt > 0")
    rows = docs.withColumn("_pii_entities", _entities(text_or_empty()))
    attempts = F.expr("cast(map() as map<string,int>)")
    if not redrawn.isEmpty():
        # the attempts of each text that has some; its hash stands for the text
        of = docs.select(F.xxhash64("text").alias("_pii_text"), F.explode(F.filter(_entities(text_or_empty()), lambda e: e["ok"])).alias("e"))
        of = of.select("_pii_text", "e.type", F.explode(_norms(F.col("e"))).alias("norm")).distinct().join(redrawn, ["type", "norm"])
        of = of.groupBy("_pii_text").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(" ", "type", "norm"), "attempt"))).alias("_pii_attempts"))
        rows = rows.withColumn("_pii_text", F.xxhash64("text")).join(of, "_pii_text", "left")
        attempts = F.coalesce("_pii_attempts", attempts)
    drawn = F.transform("_pii_entities", lambda e: F.when(e["ok"], _rendered(e, attempts, key)).otherwise(e["value"]))
    between = _followed(F.col("_pii_entities"), F.split("text", ANY, -1), attempts, key)
    whole = F.zip_with(between, drawn, lambda s, e: F.concat(s, F.coalesce(e, F.lit(""))))
    text = F.when(F.size(F.filter("_pii_entities", lambda e: e["ok"])) > 0, F.array_join(whole, "")).otherwise(F.col("text"))
    return rows.withColumn("text", text).select(docs.columns)
