"""Operator 9: PII surrogates, DataFrame functions only.

Detected entities (e-mail addresses, phone and card numbers, IBANs, social security numbers, IPv4 and IPv6 addresses,
secrets, passport numbers and names behind a key word, cloud access keys, titled names, names that begin with a common
given name, Cyrillic names by the ending of the surname) get replacements drawn by a digest of the caller's key and their
normal form:

* type and format: letters stay letters of the same case and script, digits stay digits, separators, country codes, top
  level domains, octet lengths and the issuer digit of cards stay; a card number that passes the Luhn test still does;
* gender: titles stay; a given name becomes one of the same gender (by the titles it has anywhere, else by the list of
  given names, else by its ending), a Cyrillic surname keeps its ending, an initial becomes another one;
* coreference: names are replaced word by word, and a word has one replacement wherever it stands, so Mr Smith stays the
  Smith of Mr John Smith, and Dr Alice the Alice of Dr Alice Wong, whatever else clashed; all mentions with one normal form
  (case and separators aside) get one replacement, in every document;
* distinctness: two entities of a type never share a replacement, nor is it an entity that occurs; where a draw meets
  another's, the smaller normal form keeps it and the other draws again. Later draws may be longer (addresses: any octets,
  then an IPv6 address), so there is always room and the draws end.

Texts that pass a cheap test without a hit are never searched nor shuffled. The others are searched once and written; they
meet their replacements by the hash of their text, so copies are looked up once.

Defined cases: null and empty texts stay as they are; very long texts are searched whole; repeated rows get equal results;
null ids are kept; an empty table gives no rows; other columns are untouched, but one that
has the name of the count (`n_entities` unless given) is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import let, materialise, spread_join, unused

#: Titles by gender, and common given names.
TITLES_F = "Mrs|Ms|Miss|Madam|Frau|Madame|Mme|Mademoiselle|Mlle|Señora|Señorita|Sra|Srta|госпожа|г-жа"
TITLES_M = "Mr|Sir|Herr|Herrn|Monsieur|Señor|Sr|господин|г-н"
TITLES_N = "Dr|Prof|Professor|Doctor|Rev"
GIVEN_F = (
    "Mary|Linda|Susan|Karen|Nancy|Lisa|Sarah|Emily|Emma|Olivia|Alice|Anna|Julia|Laura|Maria|Helen|Ruth|Sophie|Claire|Camille|"
    "Petra|Sabine|Ursula|Monika|Heike|Ingrid|Carmen|Lucía|Elena|Marta|Isabel|Pilar|Marie|Nathalie|Élodie|Amélie|"
    "Elizabeth|Jennifer|Jessica|Patricia|Barbara|Rachel|Hannah|Charlotte|Sophia|Amelia|Priya|Fatima|Aisha|Yuki|Mei|Olga|Katarzyna"
)
GIVEN_M = (
    "James|John|Robert|Michael|William|David|Richard|Thomas|Charles|Daniel|Peter|Paul|George|Henry|Edward|Oliver|Jack|Harry|"
    "Hans|Klaus|Jürgen|Wolfgang|Stefan|Uwe|Carlos|José|Juan|Pedro|Pablo|Diego|Pierre|Jean|Jacques|Luc|Antoine|Olivier|"
    "Joseph|Christopher|Matthew|Andrew|Kevin|Brian|Steven|Alexander|Benjamin|Samuel|Mohammed|Ahmed|Omar|Raj|Amit|Hiroshi|Piotr"
)
#: What announces a secret, a document number or a name, in any case.
_SECRET_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
_PASSPORT_WORDS = ("passport", "reisepass", "passeport", "pasaporte", "паспорт")
_NAME_WORDS = ("name is", "name:", "name ist", "ich heiße", "je m'appelle", "me llamo", "nombre es", "меня зовут")
_LOWER_TITLES = ("господин", "госпожа", "г-н", "г-жа")
_any = "|".join
_NAME_WORD = r"(?:Ma?c(?=\p{Lu})|[OD]['’](?=\p{Lu}))?\p{Lu}\p{Ll}{1,30}(?:['’-]\p{Lu}\p{Ll}{1,30})?"
_INITIALS = r"(?:\p{Lu}\. )"
_TITLED = rf"(?:(?:{TITLES_F}|{TITLES_M}|{TITLES_N})\.? ){{1,2}}{_INITIALS}{{0,2}}{_NAME_WORD}(?: {_INITIALS}?{_NAME_WORD}){{0,2}}"
_GIVEN_FIRST = rf"(?:{GIVEN_F}|{GIVEN_M}) {_INITIALS}{{0,2}}{_NAME_WORD}"
_CAPITALS = rf"(?:{GIVEN_F.upper()}|{GIVEN_M.upper()}) \p{{Lu}}{{2,30}}"
#: What announces a number to call, and how tokens of services begin.
_PHONE_WORDS = ("phone", "tel", "telefon", "telephone", "téléphone", "teléfono", "mobile", "mobil", "fax", "call", "телефон")
_TOKEN_HEADS = r"gh[pousr]_|github_pat_|glpat-|xox[abps]-|sk_live_|eyJ"
_ENDING = "(?:ова|ева|ёва|ина|ская|цкая|ов|ев|ёв|ин|ский|цкий|енко)"
_CYRILLIC_NAME = rf"[А-ЯЁ][а-яё]{{1,30}} [А-ЯЁ][а-яё]{{1,30}}{_ENDING}"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_H = "[0-9A-Fa-f]{1,4}"
#: What counts as an entity, tried in this order at each place of the text. Addresses and secrets have no
#: longest length: they run to their delimiter.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)++",
    "secret": rf"(?<=[=:\"' ])(?<=[=:] {{0,2}}[\"']?)(?<=(?i:{_any(_SECRET_WORDS)}) {{0,2}}[=:] {{0,2}}[\"']?)[^\s\"'=]{{6,}}+",
    "passport": rf"(?=[A-Z]{{0,3}}\d)(?<= )(?<=(?i:{_any(_PASSPORT_WORDS)})(?i: no| nr| number| número| numéro| №)?[.:#]{{0,2}} {{1,2}})[A-Z]{{0,3}}\d[A-Z0-9]{{4,11}}(?![A-Za-z0-9])",
    "token": rf"(?<![A-Za-z0-9_-])(?:{_TOKEN_HEADS})[A-Za-z0-9_.-]{{16,}}+|(?<=[Bb]earer )[A-Za-z0-9_.~+/-]{{16,}}+=*",
    "key": r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": rf"(?=\d)(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?\d)",
    "ip6": rf"(?<![\p{{L}}\d:.])(?=[A-Fa-f:]*\d)(?:(?:{_H}:){{7}}{_H}|(?:{_H}:){{1,6}}(?::{_H}){{1,6}}|::(?:{_H}:){{0,6}}{_H})(?![\p{{L}}\d:]|\.\d)",
    "card": r"(?<![\p{L}\d.+-])\d(?:[ -]?\d){12,18}(?![\p{L}\d])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?=[+(\d])(?<![\p{L}\d+.-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]?\d{3,4}(?![\p{L}\d])"
    r"|(?<![\p{L}\d+])\+\d{8,15}(?!\d)|(?<![\p{L}\d/.-])0\d{2,4}/ ?\d{5,8}(?![\d/])"
    rf"|(?=\d)(?<= )(?<=(?<!\p{{L}})(?i:{_any(_PHONE_WORDS)})[.:]{{0,2}} {{1,2}})\d{{7,12}}(?![\p{{L}}\d.,:/-]?\d)(?!\p{{L}})",
    "name": rf"(?=[\p{{Lu}}г])(?<![\p{{L}}-])(?:{_TITLED}|{_GIVEN_FIRST}|{_CAPITALS}|{_CYRILLIC_NAME})(?!\p{{L}})|(?=\p{{Lu}})(?<= )(?<=(?i:{_any(_NAME_WORDS)}) {{1,2}}){_NAME_WORD}(?: {_NAME_WORD})?(?!\p{{L}})",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: A text has no entity unless it matches this. What stands before a sign or a capital is looked for backwards from there:
#: a search that begins with a single character is a fast one.
HINT = (
    rf"[0-9@]|\p{{Lu}}\p{{Ll}}++ \p{{Lu}}[\p{{Ll}}.'’]|\p{{Lu}}{{2}} \p{{Lu}}{{2}}|(?:{_TOKEN_HEADS}|earer )[A-Za-z0-9_.~+/-]{{16}}|\.(?<=(?:{TITLES_F}|{TITLES_M}|{TITLES_N})\.) \p{{Lu}}|AKIA"
    rf"|[=:](?<=(?i:{_any(_SECRET_WORDS)}) {{0,2}}[=:])| \p{{Lu}}(?<=(?i:{_any(_NAME_WORDS + _LOWER_TITLES)}) {{1,2}}\p{{Lu}})"
)
_NAME_SHAPE = rf"^(?:(?:(?:{TITLES_F}|{TITLES_M}|{TITLES_N})\.? )*{_INITIALS}*{_NAME_WORD}(?: {_INITIALS}*{_NAME_WORD})*|{_CAPITALS})$"
_COUNTRY = r"^\+\d{1,3}(?=[ .(-])"
_DIGITS = ("iban", "card", "ssn", "phone")
#: Alphabets that letters are drawn from.
_LOWER, _CYRILLIC, _GREEK = "abcdefghijklmnopqrstuvwxyz", "абвгдежзиклмнопрстуфхцчшэюя", "αβγδεζηθικλμνξοπρστυφχψω"
#: First letters and vowels of the syllables of new names, by script.
_SYLLABLES = {"latin": ("bdfgklmnprstvz", "aeiou"), "cyrillic": ("бвгдзклмнпрстф", "аеиоу"), "greek": ("βγδζκλμνπρστφχ", "αεηιο")}
#: After so many draws a replacement may grow longer than its entity, after twice as many an address becomes another kind.
GROW_AFTER = 4


def hinted(text: Column) -> Column:
    """Whether a text has to be searched."""
    return F.coalesce(F.regexp_like(text, F.lit(HINT)), F.lit(False))


def kind_of(mention: Column) -> Column:
    out = F.when(F.regexp_like(mention, F.lit(_NAME_SHAPE)), F.lit("name")).otherwise(F.lit("secret"))
    for name, pattern in reversed([x for x in PATTERNS.items() if x[0] not in ("secret", "passport", "name")]):
        out = F.when(F.regexp_like(mention, F.lit(f"^(?:{pattern})$")), F.lit(name)).otherwise(out)
    out = F.when(F.regexp_like(mention, F.lit(r"^\d{7,12}$")), F.lit("phone")).otherwise(out)
    return F.when(F.regexp_like(mention, F.lit(rf"^(?:{_CYRILLIC_NAME})$")), F.lit("name")).otherwise(out)


def normal_form(kind: Column, mention: Column) -> Column:
    national = F.regexp_replace(mention, _COUNTRY, "")
    return (
        F.when(kind == "phone", F.regexp_replace(national, r"\D", ""))
        .when(kind.isin("card", "ssn"), F.regexp_replace(mention, r"\D", ""))
        .when(kind == "iban", F.replace(mention, F.lit(" "), F.lit("")))
        .when(kind.isin("email", "ip", "ip6"), F.lower(mention))
        .otherwise(mention)
    )


def name_words(mention: Column) -> Column:
    """(kind, norm, female, male, given) of each word of a name: titles stay as they are, all others are words of names.

    female, male: whether this mention's title tells the gender of a given name. given: whether the word stands where given
    names do, before the last one or alone.
    """
    words = F.split(mention, " ")
    title = lambda w: F.regexp_like(w, F.lit(rf"^(?:{TITLES_F}|{TITLES_M}|{TITLES_N})\.?$"))
    has = lambda which: F.regexp_like(mention, F.lit(rf"^(?:[^ ]+ )?(?:{which})\.? "))

    def one(w: Column, i: Column) -> Column:
        given = (i < F.size(words) - 1) | (F.size(words) == 1)
        kind = F.when(title(w), F.lit("title")).when(F.regexp_like(w, F.lit(r"^\p{Lu}\.$")), F.lit("initial")).otherwise(F.lit("name"))
        # A single word behind a title may be of either kind, but the title tells the gender of whoever bears it.
        return F.struct(
            kind.alias("kind"), F.when(kind == "name", F.lower(w)).otherwise(w).alias("norm"),
            (given & has(TITLES_F)).cast("int").alias("female"), (given & has(TITLES_M)).cast("int").alias("male"), given.cast("int").alias("given"),
        )

    return F.transform(words, one)


def drawn_as(kind: Column, norm: Column, female: Column, male: Column, given: Column) -> Column:
    """What an entity is drawn as: a word of names as given_f, given_m or surname, by all its mentions, others as their kind."""
    listed = lambda names: F.regexp_like(norm, F.lit(f"^(?:{names.lower()})$"))
    is_f = (
        F.when(female > male, F.lit(True)).when(male > female, F.lit(False))
        .when(listed(GIVEN_F), F.lit(True)).when(listed(GIVEN_M), F.lit(False)).otherwise(F.regexp_like(norm, F.lit("[aаяαη]$")))
    )
    first = F.when(is_f, F.lit("given_f")).otherwise(F.lit("given_m"))
    return F.when(kind != "name", kind).when((given > 0) | listed(GIVEN_F) | listed(GIVEN_M), first).otherwise(F.lit("surname"))


def new_initial(key: str, word: Column) -> Column:
    """Another initial, by a rotation of each alphabet that depends on the key: no two become the same."""
    import hashlib

    for letters in (_LOWER, _CYRILLIC, _GREEK):
        turn = int(hashlib.sha256(f"{key}\x1f{letters}".encode()).hexdigest(), 16) % (len(letters) - 1) + 1
        word = F.translate(word, letters.upper(), letters.upper()[turn:] + letters.upper()[:turn])
    return word


def _drawn(key: str, kind: Column, seed: Column, attempt: int) -> Column:
    """256 hex digits: two for each of 128 characters."""
    return F.concat(*[F.sha2(F.concat_ws("\x1f", F.lit(key), kind, seed, F.lit(f"{attempt}.{i}")), 256) for i in range(4)])


def _pick(alphabet: str, value: Column) -> Column:
    return F.substring(F.lit(alphabet), (value % len(alphabet) + 1).cast("int"), F.lit(1))


def _byte(drawn: Column, i: Column) -> Column:
    return F.conv(F.substring(drawn, ((i % 128) * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int") + (i / 128).cast("int")


def _mapped(text: Column, drawn: Column, all_hex: bool = False) -> Column:
    """text with each letter or digit replaced by one of its class."""
    hexed = F.lit(True) if all_hex else F.regexp_like(text, F.lit(r"^[0-9a-f]{12,}$"))

    def one(c: Column, i: Column) -> Column:
        v = _byte(drawn, i)
        low = F.lower(c)
        small = (
            F.when(low.rlike("[a-z]") & hexed, _pick("abcdef", v))
            .when(low.rlike("[a-z]"), _pick(_LOWER, v))
            .when(low.rlike(r"\p{IsCyrillic}"), _pick(_CYRILLIC, v))
            .when(low.rlike(r"\p{IsGreek}"), _pick(_GREEK, v))
            .when(low.rlike(r"\p{IsLatin}"), _pick(_LOWER, v))
            .otherwise(low)
        )
        return F.when(c.rlike("[0-9]"), (v % 10).cast("string")).when(c != low, F.upper(small)).otherwise(small)

    return F.array_join(F.transform(F.split(text, ""), one), "")


def luhn_sum(digits: Column) -> Column:
    """Weighted digit sum; a multiple of ten for a valid number."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when((n - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


def new_word(kind: Column, norm: Column, drawn: Column, attempt: int) -> Column:
    """A name's word in lower case: a listed given name first, syllables later, more of them with each second draw."""
    n = 2 + attempt // 2

    def syllables(script: str) -> Column:
        letters, vowels = _SYLLABLES[script]
        one = lambda i: F.concat(_pick(letters, _byte(drawn, i * 2)), _pick(vowels, _byte(drawn, i * 2 + 1)))
        return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), one), "")

    female, given = kind == "given_f", kind.isin("given_f", "given_m")
    listed = lambda names: F.lower(F.element_at(F.array(*map(F.lit, names.split("|"))), _byte(drawn, F.lit(0)) % len(names.split("|")) + 1))
    latin = F.concat(syllables("latin"), F.when(given, F.when(female, F.lit("na")).otherwise(F.lit("ro"))).otherwise(F.lit("")))
    if attempt < 2:
        latin = F.when(female, listed(GIVEN_F)).when(given, listed(GIVEN_M)).otherwise(latin)
    ending = F.regexp_extract(norm, f"{_ENDING}$", 0)
    cyrillic = F.concat(syllables("cyrillic"), F.when(given, F.when(female, F.lit("на")).otherwise(F.lit("р"))).otherwise(ending))
    greek = F.concat(syllables("greek"), F.when(given, F.when(female, F.lit("να")).otherwise(F.lit("ρος"))).otherwise(F.lit("")))
    return F.when(norm.rlike(r"\p{IsCyrillic}"), cyrillic).when(norm.rlike(r"\p{IsGreek}"), greek).otherwise(latin)


def surrogate(key: str, kind: Column, norm: Column, attempt: int) -> Column:
    """The attempt-th draw for a normal form."""
    drawn = _drawn(key, kind, norm, attempt)
    grown = F.substring(F.regexp_replace(drawn, r"\D", ""), F.lit(1), F.lit(attempt // GROW_AFTER))
    local, domain = F.substring_index(norm, "@", 1), F.substring_index(norm, "@", -1)
    top = F.substring_index(domain, ".", -1)
    host = F.substring(domain, F.lit(1), F.length(domain) - F.length(top) - 1)
    email = F.concat(
        let(drawn, lambda d: _mapped(local, d)), grown, F.lit("@"),
        let(_drawn(key, F.lit("domain"), host, 0), lambda d: _mapped(host, d)), F.lit("."), top,
    )

    def octet(d: Column, o: Column, i: Column) -> Column:
        v = F.conv(F.substring(d, (i * 8 + 1).cast("int"), F.lit(7)), 16, 10).cast("bigint")
        kept = F.when(F.length(o) == 1, v % 9 + 1).when(F.length(o) == 2, v % 90 + 10).otherwise(v % 156 + 100)
        return (v % 254 + 1 if attempt >= GROW_AFTER else kept).cast("string")

    far = F.concat_ws(":", F.lit("fd00"), *[F.substring(drawn, 4 * i + 1, 4) for i in range(7)])
    ip, ip6 = far, far
    if attempt < 2 * GROW_AFTER:
        ip = let(drawn, lambda d: F.array_join(F.transform(F.split(norm, r"\."), lambda o, i: octet(d, o, i)), "."))
    if attempt < GROW_AFTER:
        ip6 = let(drawn, lambda d: _mapped(norm, d, True))

    def card(d: Column) -> Column:
        body = F.concat(F.substring(norm, F.lit(1), F.lit(1)), F.substring(_mapped(norm, d), F.lit(2), F.length(norm) - 2), grown)
        check = let(body, lambda b: (10 - luhn_sum(F.concat(b, F.lit("0"))) % 10) % 10)
        wrong = F.when(luhn_sum(norm) % 10 == 0, F.lit(0)).otherwise(F.lit(1))
        return F.concat(body, ((check + wrong) % 10).cast("string"))

    key_id = F.concat(F.lit("AKIA"), let(drawn, lambda d: _mapped(F.substring(norm, F.lit(5), F.lit(16)), d)), grown)
    begin = F.regexp_extract(norm, f"^(?:{_TOKEN_HEADS})", 0)
    token = F.concat(begin, let(drawn, lambda d: _mapped(F.substring(norm, F.length(begin) + 1, F.length(norm)), d)), grown)
    iban = F.concat(F.substring(norm, F.lit(1), F.lit(2)), let(drawn, lambda d: _mapped(F.substring(norm, F.lit(3), F.length(norm)), d)), grown)
    return (
        F.when(kind == "email", email)
        .when(kind == "ip", ip)
        .when(kind == "ip6", ip6)
        .when(kind == "card", let(drawn, card))
        .when(kind.isin("given_f", "given_m", "surname"), let(drawn, lambda d: new_word(kind, norm, d, attempt)))
        .when(kind == "key", key_id)
        .when(kind == "token", token)
        .when(kind == "iban", iban)
        .otherwise(F.concat(let(drawn, lambda d: _mapped(norm, d)), grown))
    )


def rendered(kind: Column, mention: Column, new: Column) -> Column:
    """The replacement in the shape of one mention: its separators, its country code, its capitals."""
    prefix = F.when(kind == "phone", F.regexp_extract(mention, _COUNTRY, 0)).otherwise(F.lit(""))
    rest = F.substring(mention, F.length(prefix) + 1, F.length(mention))
    taken = r"[A-Z0-9]"

    def put(s: Column, c: Column) -> Column:
        own = c.rlike(taken)
        return F.struct(
            F.concat(s["o"], F.when(own, F.substring(new, s["i"], F.lit(1))).otherwise(c)).alias("o"),
            (s["i"] + F.when(own, F.lit(1)).otherwise(F.lit(0))).alias("i"),
        )

    shaped = F.aggregate(
        F.split(rest, ""), F.struct(F.lit("").alias("o"), F.lit(1).alias("i")), put,
        lambda s: F.concat(s["o"], F.substring(new, s["i"], F.length(new))),
    )
    capitals = F.array_join(
        F.zip_with(F.split(new, ""), F.split(mention, ""), lambda c, m: F.when(m.rlike(r"\p{Lu}"), F.upper(c)).otherwise(c)), ""
    )
    name = F.concat(F.upper(F.substring(new, 1, 1)), F.substring(new, F.lit(2), F.length(new)))
    name = F.when(F.regexp_like(mention, F.lit(r"\p{Lu}{2,}$")), F.upper(new)).otherwise(name)
    return (
        F.when(kind.isin(*_DIGITS), F.concat(prefix, shaped)).when(kind.isin("email", "ip6"), capitals)
        .when(kind == "name", name).otherwise(new)
    )


def _family(kind: Column) -> Column:
    """Kinds whose replacements must differ from each other: all words of names together."""
    return F.when(kind.isin("given_f", "given_m", "surname"), F.lit("name")).otherwise(kind)


def assign(entities: DataFrame, key: str) -> DataFrame:
    """(kind, norm, new) for distinct (kind, norm): replacements that no two entities of a kind share and that are none
    of the entities of the kind."""
    pending, settled = materialise(entities.select("kind", "norm").distinct(), "entities"), None
    family = _family(F.col("kind")).alias("family")
    own = pending.select(family, F.col("norm").alias("new"))
    attempt = 0
    while settled is None or not pending.isEmpty():
        drawn = pending.withColumn("new", surrogate(key, F.col("kind"), F.col("norm"), attempt)).withColumn("family", family)
        won = drawn.groupBy("family", "new").agg(F.min(F.struct("norm", "kind")).alias("_w"))
        won = won.join(own, ["family", "new"], "left_anti")
        if settled is not None:
            won = won.join(settled.select(family, "new"), ["family", "new"], "left_anti")
        won = materialise(won.select("_w.kind", "_w.norm", "new"), "won")
        settled = won if settled is None else settled.unionByName(won)
        pending = materialise(pending.join(won.select("kind", "norm"), ["kind", "norm"], "left_anti"), "pending")
        attempt += 1
    return settled


def replace_pii(documents: DataFrame, key: str, text: str = "text", count: str = "n_entities") -> DataFrame:
    """documents with replaced entities and, in `count`, how many mentions each text had. Without the key nobody can find
    the replacement of an entity; with it the same entity always has the same one, clashes aside."""
    if not key:
        raise ValueError("surrogates need a key")
    documents = documents.drop(*[c for c in documents.columns if c.lower() == count.lower()])
    columns = documents.columns
    sha, parts, renewed, times = unused(columns, "_sha", "_parts", "_new", "_copies")
    whole = F.col(f"`{text}`")
    clean = documents.where(~hinted(whole)).withColumn(count, F.lit(0))
    found = documents.where(hinted(whole)).withColumn(sha, F.sha2(whole, 256))
    # A mark that the text cannot hold parts its mentions from what lies between; one search finds them all.
    mark = F.concat(F.lit("\ufdd0"), F.col(sha))
    split = F.split(F.regexp_replace(whole, F.lit(ANY), F.concat(mark, F.lit("$0"), mark)), mark, -1)
    found = materialise(found.withColumn(parts, split), "searched")
    n_entities = F.expr(f"int((size(`{parts}`) - 1) div 2)")
    with_some = found.where(n_entities > 0)
    copies = with_some.groupBy(F.col(sha).alias("sha")).agg(F.first(parts).alias("parts"), F.count("*").alias(times))
    distinct = materialise(copies, "texts")
    mentions = distinct.select("sha", F.posexplode("parts").alias("pos", "mention")).where("pos % 2 = 1")
    mentions = mentions.withColumn("kind", kind_of(F.col("mention")))
    zero = lambda n: F.lit(0).alias(n)
    one = F.array(F.struct(F.col("kind"), normal_form(F.col("kind"), F.col("mention")).alias("norm"), zero("female"), zero("male"), zero("given")))
    words = F.when(F.col("kind") == "name", name_words(F.col("mention"))).otherwise(one)
    tokens = mentions.select("sha", "pos", "mention", F.posexplode(words).alias("i", "w"))
    mention = F.when(F.col("w.kind") == "name", F.get(F.split("mention", " "), F.col("i"))).otherwise(F.col("mention"))
    tokens = materialise(tokens.select("sha", "pos", mention.alias("mention"), "i", "w.*"), "mentions")
    fixed = F.col("kind").isin("title", "initial")
    entities = tokens.where(~fixed).groupBy("kind", "norm").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in ("female", "male", "given")])
    drawn = drawn_as(*[F.col(c) for c in ("kind", "norm", "female", "male", "given")])
    entities = materialise(entities.select("kind", "norm", "n", drawn.alias("draw")), "counted")
    new = assign(entities.select(F.col("draw").alias("kind"), "norm"), key).withColumnRenamed("kind", "draw")
    assigned = materialise(entities.join(new, ["draw", "norm"]).select("kind", "norm", "n", "new"), "assigned")
    short = (F.length("norm") < 1000) & (F.length("new") < 1000)
    named = spread_join(tokens.where(~fixed), assigned, ["kind", "norm"], "n", short)
    named = named.select("sha", "pos", "i", rendered(F.col("kind"), F.col("mention"), F.col("new")).alias("new"))
    named = named.unionByName(tokens.where(fixed).select("sha", "pos", "i", F.when(F.col("kind") == "title", F.col("norm")).otherwise(new_initial(key, F.col("norm"))).alias("new")))
    by_mention = named.groupBy("sha", "pos").agg(F.array_join(F.sort_array(F.collect_list(F.struct("i", "new")))["new"], " ").alias("new"))
    by_text = by_mention.groupBy("sha").agg(F.sort_array(F.collect_list(F.struct("pos", "new")))["new"].alias(renewed))
    by_text = materialise(by_text.join(distinct.select("sha", times), "sha").withColumnRenamed("sha", sha), "replacements")
    light = F.length(F.array_join(renewed, "")) < 10_000
    joined = spread_join(with_some, by_text, sha, times, light).drop(times).unionByName(found.where(n_entities == 0).withColumn(renewed, F.lit(None).cast("array<string>")))
    between = F.filter(F.col(parts), lambda _, i: i % 2 == 0)
    woven = F.array_join(F.zip_with(between, F.col(renewed), lambda p, n: F.concat(p, F.coalesce(n, F.lit("")))), "")
    done = joined.withColumn(text, F.when(n_entities > 0, woven).otherwise(whole)).withColumn(count, n_entities)
    return done.select(*[F.col(f"`{c}`") for c in columns], count).unionByName(clean)
