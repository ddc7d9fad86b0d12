"""Personal data is replaced by surrogates: of the same kind, format and script, and for names of the same gender.

A surrogate is the entity itself, enciphered under a key: each character moves within its own alphabet (digits to
digits, vowels to vowels), by amounts drawn from the key and the rest of the entity, in a Feistel network. That can
be undone with the key, so two entities of one format never get one surrogate, and the same entity gets the same one in
every document and on every machine, without a table of entities. All of it is Spark's own expressions, row by row.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIGITS = "0123456789"
_LATIN = ("aeiouy", "bcdfghjklmnpqrstvwxz", "AEIOUY", "BCDFGHJKLMNPQRSTVWXZ", "äöüéèêàáíóúñçß", "ÄÖÜÉÈÊÀÁÍÓÚÑÇ")
_OTHER = ("аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "АЕИОУЭЮЯ", "БВГДЖЗКЛМНПРСТФХЦЧШЩ", "αειουηω", "βγδζθκλμνξπρστφχψ", "ΑΕΙΟΥΗΩ", "ΒΓΔΖΘΚΛΜΝΞΠΡΣΤΦΧΨ")
_CODE = (DIGITS, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_HEX = (DIGITS, "abcdef", "ABCDEF")

# Given names by gender and script; a name moves within its own list.
FIRST_NAMES = {
    "female": ["Anna", "Maria", "Julia", "Laura", "Emma", "Sophie", "Claire", "Camille", "Carmen", "Lucia", "Elena", "Alice", "Mary", "Linda", "Susan", "Karen", "Sarah", "Emily", "Petra", "Sabine"],
    "male": ["Peter", "Thomas", "Michael", "Hans", "Jürgen", "Pierre", "Jean", "Luc", "Carlos", "Javier", "Miguel", "James", "John", "Robert", "David", "William", "Paul", "Mark", "Stefan", "Andreas"],
    "female Cyrillic": ["Анна", "Мария", "Елена", "Ольга", "Наталья", "Ирина", "Татьяна", "Светлана"],
    "male Cyrillic": ["Иван", "Пётр", "Сергей", "Алексей", "Дмитрий", "Андрей", "Михаил", "Николай"],
}
_TITLES = ("Mr", "Mrs", "Ms", "Miss", "Herr", "Frau", "Señor", "Señora", "Sr", "Sra", "Monsieur", "Madame", "Mme", "Dr", "Prof")
_KNOWN = f"(?=[{''.join(sorted({n[0] for names in FIRST_NAMES.values() for n in names}))}])(?:{'|'.join(n for names in FIRST_NAMES.values() for n in names)})"
_NAME = r"\p{Lu}\p{Ll}+(?:-\p{Lu}\p{Ll}+)?"

# A blank inside a phone: not before an ssn, an ip or the groups of a card.
_ON = r" (?![0-9]{3}-[0-9]{2}-[0-9]{4}|[0-9]{1,3}(?:\.[0-9]{1,3}){3}|[0-9]{4}(?:[ -][0-9]{4}){2}|[0-9]{4}[ -][0-9]{6}[ -]|[0-9]{13})"

# Kind -> pattern. Borders keep every pattern from being tried again inside a long word.
PATTERNS = {
    # no repeated group here: the engine would go one call deeper with each label of a domain
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-][A-Za-z0-9.-]*(?<=[A-Za-z0-9-]\.[A-Za-z]{2,63})(?![A-Za-z])",
    "secret": r"(?<=(?i:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key)\s{0,2}[=:]\s{0,2}[\"']?)[A-Za-z0-9_+/-]{8,}+"
    r"|AKIA[0-9A-Z]{16}(?![0-9A-Za-z])|gh[pousr]_[A-Za-z0-9]{36}(?![0-9A-Za-z])",
    "ip": r"(?<![0-9A-Za-z.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?![0-9A-Za-z]|\.[0-9])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "card": r"(?<![0-9A-Za-z+.-])[1-9][0-9]{3}(?:[ -][0-9]{4}){3}(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z+])(?![0-9]{2,4} \(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z]))(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9A-Za-z])|(?<![0-9A-Za-z+])\+[0-9]{8,15}(?![0-9A-Za-z])"
    # + and 8 to 15 digits in groups of any size; a leading 0 and 9 to 12 digits (no dates); nine digits as in Spain; ten digits in one after a word for phone.
    rf"|(?<![0-9A-Za-z+])\+(?:(?:[.-]|{_ON}|[ /-]?\(|\)[ /-]?|/)?[0-9]){{8,15}}(?![0-9A-Za-z])"
    rf"|(?<![0-9A-Za-z+.,/-])(?!0[0-9][ ./-][0-9]{{2}}[ ./-](?:19|20)[0-9]{{2}}(?![0-9]))(?=0[0-9]{{1,6}}[ /-])0(?:(?:(?:{_ON}|[/-])(?=[0-9]{{2}}))?[0-9]){{8,11}}(?![0-9A-Za-z])"
    r"|(?<![0-9A-Za-z+.,/-])0[0-9](?:\.[0-9]{2}){4}(?![0-9A-Za-z]|\.[0-9])"
    r"|(?<![0-9A-Za-z+.,/-])\(0[0-9]{1,5}\)(?: ?[/-]? ?[0-9]{2,8}){1,4}(?![0-9A-Za-z])"
    r"|(?<![0-9A-Za-z+.,/-])[6-9][0-9]{2}(?: [0-9]{2}){3}(?![0-9A-Za-z]| [0-9])"
    r"|(?<=\b(?i:phone|tel|telephone|telefon|téléphone|teléfono|tél|mobile|móvil|handy|call|fax|cell)\b[.:]{0,2} {0,2})[0-9]{9,12}(?![0-9A-Za-z])",
    "name": rf"(?<=\b(?:{'|'.join(_TITLES)})\.?[ ]){_NAME}(?: {_NAME})?|(?<![\p{{L}}]){_KNOWN} {_NAME}",
}
#: What card numbers are made of: at each start, the most whole groups of digits, 13 to 19 of them. Which of its beginnings is a card, Luhn's check says.
RUN = r"(?<![0-9A-Za-z+.])(?<!(?<![0-9])-)(?=([0-9](?:[ -]?[0-9]){12,18})(?![0-9A-Za-z]))"
# Groupings of cards. Other runs that pass the check count as cards where they are no phones and hold no phone or ssn.
_GROUPED = r"\A(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){2,3}(?:[ -][0-9]{1,4})?|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5}|[0-9]{4}(?:[ -][0-9]{3}){3}|[0-9]{6}[ -][0-9]{7,13}|[0-9]{8}[ -][0-9]{8})\z"
_HOLDS_OTHER = r"(?<![0-9])[0-9]{3}(?:-[0-9]{2}(?:-|\z)|[ -][0-9]{3}[ -][0-9]{4}(?![0-9]))"
# Groups before a card that a phone, or four groups of four digits, would take along with its first ones.
_LEADS_ON = r"(?:(?:[0-9]{4}[ -]){1,3}|\+[0-9]{1,3}[ .-]|(?:\+[0-9]{1,3}[ .-]?)?(?:\(?[0-9]{2,4}\)?[ .-]{1,2}){1,2})"
_SURE = r"(?<![0-9A-Za-z+.])(?<!(?<![0-9])-)(?=[0-9](?:[ -]?[0-9]){12})(?:"


def _any() -> list[str]:
    """The pattern of all kinds, cut where the cards of a text go: grouped ones after the ssn, others after the phone. All kinds
    begin at the start of a word: the first look is cheap, and the patterns are tried there only."""
    parts = {kind: f"(?:{p})" for kind, p in PATTERNS.items()}
    first, second = (list(parts).index(k) + 1 for k in ("ssn", "phone"))
    kinds = list(parts.values())
    start = r"(?<![0-9A-Za-z])(?=[\p{Lu}0-9A-Za-z+(._%/-])(?:"
    return [start + "|".join(kinds[:first]), "|".join(kinds[first:second]), "|" + "|".join(kinds[second:]) + ")"]


#: For texts without cards. Four groups of four digits that are no card are none of the other kinds either.
ANY = "{}|{}{}".format(*_any())
#: Texts without any of these hold no entity and are not looked at further.
HINT = rf"[0-9@]|[=:](?<=(?i:token|secret|password|passwd|pwd|key)\s{{0,2}}[=:])|(?<![\p{{L}}])(?:(?=[{''.join(sorted({t[0] for t in _TITLES}))}])(?:{'|'.join(_TITLES)})\b|{_KNOWN} )"


def _let(value: Column, use) -> Column:
    """`use` of a value that is worked out once."""
    return F.transform(F.array(value), use)[0]


def _text(s: str) -> Column:
    return F.lit(s)


def _moved(half: Column, other: Column, alphabets: tuple[str, ...], seed: Column) -> Column:
    """Each character of `half` moved within its alphabet by two hexadecimal digits of a hash of the seed and `other`."""
    blocks = F.sequence(F.lit(0), F.floor(F.length(half) / 32).cast("int"))
    stream = F.array_join(F.transform(blocks, lambda b: F.sha2(F.concat_ws("|", seed, b.cast("string"), other), 256)), "")

    def one(c: Column, i: Column, keys: Column) -> Column:
        by = F.conv(F.substring(keys, i * 2 + 1, F.lit(2)), 16, 10).cast("int")
        out = c
        for letters in alphabets:
            at = F.instr(_text(letters), c)
            out = F.when(at > 0, F.substring(_text(letters), (at - 1 + by) % len(letters) + 1, F.lit(1))).otherwise(out)
        return out

    return F.when(F.length(half) == 0, half).otherwise(_let(stream, lambda keys: F.array_join(F.transform(F.split(half, ""), lambda c, i: one(c, i, keys)), "")))


def cipher(text: Column, alphabets: tuple[str, ...], key: Column, purpose: str) -> Column:
    """A keyed one-to-one map of strings that keeps length and the alphabet of each character."""

    def network(s: Column) -> Column:
        middle = F.floor(F.length(s) / 2).cast("int")
        begin = F.struct(F.substring(s, F.lit(1), middle).alias("a"), F.substring(s, middle + 1, F.length(s)).alias("b"))

        def step(h: Column, i: Column) -> Column:
            seed = F.concat_ws("|", key, F.lit(purpose), i.cast("string"))
            left = F.struct(_moved(h["a"], h["b"], alphabets, seed).alias("a"), h["b"].alias("b"))
            right = F.struct(h["a"].alias("a"), _moved(h["b"], h["a"], alphabets, seed).alias("b"))
            return F.when(i % 2 == 0, left).otherwise(right)

        return F.aggregate(F.sequence(F.lit(0), F.lit(5)), begin, step, lambda h: F.concat(h["a"], h["b"]))

    return _let(text, network)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _laid_over(text: Column, digits: Column) -> Column:
    """`text` with its digits, in order, exchanged for `digits`."""

    def step(state: Column, c: Column) -> Column:
        is_digit = F.instr(_text(DIGITS), c) > 0
        return F.struct(F.concat(state["out"], F.when(is_digit, F.substring(digits, state["at"], F.lit(1))).otherwise(c)).alias("out"), (state["at"] + is_digit.cast("int")).alias("at"))

    return F.aggregate(F.split(text, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("at")), step, lambda s: s["out"])


def _luhn(digits: Column, doubled: int) -> Column:
    """Luhn sum; from the right, digits at places of the parity `doubled` count twice."""

    def part(d: Column, i: Column) -> Column:
        n = d.cast("int")
        twice = F.when(n > 4, 2 * n - 9).otherwise(2 * n)
        return F.when(i % 2 == doubled, twice).otherwise(n)

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), part), F.lit(0), lambda a, b: a + b)


def _names(name: Column, key: Column) -> Column:
    """Known given names move within their list, by an amount that the key sets; all other parts are enciphered."""

    def part(p: Column) -> Column:
        out = cipher(p, _LATIN + _OTHER, key, "name")
        for gender, names in FIRST_NAMES.items():
            at = F.array_position(F.lit(names), p).cast("int")
            by = 1 + F.conv(F.substring(F.sha2(F.concat_ws("|", key, F.lit(gender)), 256), 1, 6), 16, 10).cast("int") % (len(names) - 1)
            out = F.when(at > 0, F.element_at(F.lit(names), (at - 1 + by) % len(names) + 1)).otherwise(out)
        return out

    return F.array_join(F.transform(F.split(name, " "), part), " ")


def kind_of(entity: Column) -> Column:
    """The first kind whose pattern fits a whole entity; lookbehinds are dropped, as the entity stands alone. Numbers that fail
    Luhn's check are no cards, and stay as they are."""
    digits = _digits(entity)
    octet = r"\A[0-9]{1,3}(?:\.[0-9]{1,3}){3}\z"
    return (
        F.when(entity.contains("@"), "email")
        .when(F.rlike(entity, F.lit(octet)), "ip")
        .when(F.rlike(entity, F.lit(r"\A[0-9]{3}-[0-9]{2}-[0-9]{4}\z")), "ssn")
        .when(F.rlike(entity, F.lit(r"\A[0-9](?:[ -]?[0-9]){12,18}\z")), F.when(_luhn(digits, 1) % 10 == 0, "card"))
        .when(F.rlike(entity, F.lit(r"\A[+(]?[0-9][0-9 ()./-]*\z")) & (F.length(digits) <= 18), "phone")
        .when(F.rlike(entity, F.lit(r"\A[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3}")), "iban")
        .when(F.rlike(entity, F.lit(rf"\A{_NAME}(?: {_NAME})?\z")), "name")
        .otherwise("secret")
    )


def surrogate(entity: Column, kind: Column, key: Column) -> Column:
    """The replacement of an entity. Emails count without case, phones and cards without separators, so that all spellings of one
    get spellings of one surrogate. Cards keep their first digit and stay valid, phones keep a country code after `+`,
    emails their last label; a hexadecimal secret stays one."""
    lower = F.lower(entity)
    local, domain = F.substring_index(lower, "@", 1), F.substring_index(lower, "@", -1)
    last = F.substring_index(domain, ".", -1)
    email = F.concat(cipher(local, _CODE, key, "local"), F.lit("@"), cipher(F.substring(domain, F.lit(1), F.length(domain) - F.length(last)), _CODE, key, "domain"), last)

    octets = F.transform(F.split(entity, r"\."), lambda o: F.lpad(F.hex(o.cast("long")), 2, "0"))
    hidden = cipher(F.array_join(octets, ""), ("0123456789ABCDEF",), key, "ip")
    ip = _let(hidden, lambda h: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.conv(F.substring(h, i * 2 + 1, F.lit(2)), 16, 10)), "."))

    def card(d: Column) -> Column:
        body = F.concat(F.substring(d, 1, 1), cipher(F.substring(d, F.lit(2), F.length(d) - 2), (DIGITS,), key, "card"))
        return _let(body, lambda b: F.concat(b, ((10 - _luhn(b, 0) % 10) % 10).cast("string")))

    code = F.regexp_extract(entity, r"\A\+[0-9]{1,3}(?=[ ./(-])", 0)
    code = F.when(code == "", F.regexp_extract(entity, r"\A\+[0-9]", 0)).otherwise(code)
    rest = F.substring(entity, F.length(code) + 1, F.length(entity))
    phone = F.concat(code, _laid_over(rest, cipher(_digits(rest), (DIGITS,), key, "phone")))
    is_hex = F.rlike(entity, F.lit(r"\A[0-9a-f]+\z"))
    prefix = F.regexp_extract(entity, r"\A(?:AKIA(?=[0-9A-Z]{16}\z)|gh[pousr]_)", 0)
    secret = F.when(is_hex, cipher(entity, _HEX, key, "hex")).otherwise(F.concat(prefix, cipher(F.substring(entity, F.length(prefix) + 1, F.length(entity)), _CODE, key, "secret")))
    plain = F.regexp_replace(entity, " ", "")
    iban = F.concat(F.substring(plain, 1, 2), cipher(F.substring(plain, F.lit(3), F.length(plain)), _CODE, key, "iban"))
    return (
        F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "card", _laid_over(entity, card(_digits(entity))))
        .when(kind == "ssn", _laid_over(entity, cipher(_digits(entity), (DIGITS,), key, "ssn"))).when(kind == "phone", phone)
        .when(kind == "iban", iban).when(kind == "name", _names(entity, key)).when(kind == "secret", secret).otherwise(entity)
    )


def _cards(text: Column) -> Column:
    """All numbers in a text that pass Luhn's check, also those that are the beginning of a longer run of digits; long ones first."""
    beginnings = [rf"\A[0-9](?:[ -]?[0-9]){{{n - 1}}}(?![0-9])" for n in range(19, 12, -1)]
    runs = F.array_distinct(F.regexp_extract_all(text, F.lit(RUN), F.lit(1)))
    tried = F.flatten(F.transform(runs, lambda r: F.array(*[F.regexp_extract(r, b, 0) for b in beginnings])))
    passed = F.array_distinct(F.filter(tried, lambda t: F.when(t != "", _luhn(_digits(t), 1) % 10 == 0).otherwise(F.lit(False))))
    return F.reverse(F.array_sort(F.transform(passed, lambda t: F.struct(F.length(t).alias("n"), t.alias("t")))))["t"]


def pattern(text: Column) -> Column:
    """The pattern for a text: ANY, with the cards of the text in it word for word."""
    first, second, third = _any()

    def with_cards(cards: Column) -> Column:
        def listed(some: Column) -> Column:
            return F.when(F.size(some) > 0, F.concat(F.lit(_SURE), F.array_join(some, "|"), F.lit(")(?![0-9A-Za-z])"))).otherwise("(?!)")

        grouped = F.filter(cards, lambda c: F.rlike(c, F.lit(_GROUPED)))
        other = F.filter(cards, lambda c: ~F.rlike(c, F.lit(f"{_GROUPED}|{_HOLDS_OTHER}")))
        whole = F.concat(F.lit(f"{first}|"), listed(grouped), F.lit(f"|(?!{_LEADS_ON}"), listed(grouped), F.lit(f")(?:{second})|"), listed(other), F.lit(third))
        return F.when(F.size(cards) > 0, whole).otherwise(F.lit(ANY))

    return F.when(F.rlike(text, F.lit(RUN)), _let(_cards(text), with_cards)).otherwise(F.lit(ANY))


def _fitting(text: Column, any_kind: Column) -> Column:
    return F.when(F.rlike(text, F.lit(HINT)), F.regexp_extract_all(text, F.concat(F.lit("("), any_kind, F.lit(")")), F.lit(1))).otherwise(F.array().cast("array<string>"))


def found(text: Column) -> Column:
    """Everything in a text that one of the patterns fits, in order."""
    return _let(pattern(text), lambda p: _fitting(text, p))


def pseudonymised(df: DataFrame, text: str, key: str, out: str = "entities") -> DataFrame:
    """Replace the entities in the column `text`, in place, and add `out`: their kinds, in order.

    The key is a literal of the plan: whoever reads plans can read it. In each text it is checked that no surrogate
    is an entity of that text, and that distinct entities have distinct surrogates; where not, the text's entities are done over
    with a second key. Null stays null, with no kinds; texts without entities stay as they are, and whole texts are searched.
    Repeated rows get the same answer, empty tables stay empty. All other columns stay; one named `out` is replaced.
    """
    column = f"`{text}`"

    def entities(raw: Column) -> Column:
        return F.transform(raw, lambda e: F.struct(e.alias("e"), kind_of(e).alias("kind")))

    def replaced(es: Column) -> Column:
        def under(name: str) -> Column:
            return F.transform(es, lambda x: surrogate(x["e"], x["kind"], F.lit(name)))

        real = F.transform(F.filter(es, lambda x: x["kind"].isNotNull()), lambda x: x["e"])
        return _let(under(key), lambda s: F.when(_clean(es, real, s), s).otherwise(under(f"{key} again")))

    def _clean(es: Column, real: Column, made: Column) -> Column:
        changed = F.filter(F.zip_with(es, made, lambda x, s: F.when(x["kind"].isNotNull(), s)), lambda s: s.isNotNull())
        return ~F.arrays_overlap(changed, real) & (F.size(F.array_distinct(changed)) <= F.size(F.array_distinct(real)))

    body = F.col(column).cast("string")

    def rebuilt(es: Column, any_kind: Column) -> Column:
        between = F.split(body, any_kind, -1)
        pieces = _let(replaced(es), lambda s: F.zip_with(between, s, lambda b, r: F.concat(b, F.coalesce(r, F.lit("")))))
        return F.when(F.size(es) > 0, F.array_join(pieces, "")).otherwise(body)

    def all_made(any_kind: Column) -> Column:
        return F.transform(F.array(entities(_fitting(body, any_kind))), lambda es: F.struct(rebuilt(es, any_kind).alias("text"), F.filter(F.transform(es, lambda x: x["kind"]), lambda k: k.isNotNull()).alias("kinds")))

    made = _let(pattern(body), all_made)
    rows = df.drop(out) if text != out else df
    kept = [F.col("_made.text").alias(c) if c == text else F.col(f"`{c}`") for c in rows.columns]
    done = rows.select("*", F.inline(F.transform(made, lambda m: F.struct(m.alias("_made")))))
    return done.select(*kept, F.coalesce(F.col("_made.kinds"), F.array().cast("array<string>")).alias(out))


def collisions(df: DataFrame, text: str, key: str) -> DataFrame:
    """An audit over all texts: surrogates that stand for more than one entity, or for themselves. It should be empty."""
    one = df.select(F.explode(F.array_distinct(found(F.col(f"`{text}`").cast("string")))).alias("e"))
    one = one.withColumn("kind", kind_of(F.col("e"))).where("kind is not null")
    norm = F.when(F.col("kind") == "email", F.lower("e")).when(F.col("kind").isin("phone", "card", "ssn"), _digits(F.col("e"))).otherwise(F.col("e"))
    pairs = one.select("kind", norm.alias("entity"), F.col("e")).dropDuplicates(["kind", "e"]).withColumn("surrogate", surrogate(F.col("e"), F.col("kind"), F.lit(key)))
    return pairs.groupBy("kind", "surrogate").agg(F.countDistinct("entity").alias("entities"), F.max((F.col("e") == F.col("surrogate")).cast("int")).alias("unchanged")).where("entities > 1 or unchanged = 1")
