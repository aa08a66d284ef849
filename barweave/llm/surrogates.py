"""Personal data replaced by surrogates, with DataFrame and SQL functions only.

Entities are found with one regular expression: addresses, phone and card numbers, network addresses, account and social security numbers,
access keys, passwords and tokens, and names behind a title. An entity has one or more components (an address: the mailbox and the
domain; a name: each word), and each distinct component gets one surrogate in the whole corpus, drawn from a keyed hash:

* digits become digits, letters letters of their case and script, hexadecimal stays hexadecimal, punctuation stays; card
  numbers keep a valid (or invalid) check digit; network addresses go to the reserved block 240.0.0.0/4; domains to ``example.com``,
  ``.net`` or ``.org``; names follow the title's gender and their script;
* equal components have equal surrogates whatever their layout or case (a phone number with and without dots, a name with and without a
  first name behind titles of one gender), so references to one person stay references to one; a word of a name found in a text is
  also replaced where it stands in that text without a title (of two surrogates for one word, by that of its first titled mention);
* surrogates are checked against each other and against the real components of their kind; the loser of a collision draws again
  with a longer surrogate, until all are distinct.

Tables of distinct components are joined by Spark; each text is cut at its entities and put together again in one
expression. Only texts with entities are shuffled.

Edge cases: null and empty texts, and texts without entities, stay as they are; repeated rows and null ids get the same text as their
equals; n_entities counts what the expression finds, 0 for a null text; other columns pass, but a column named n_entities is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored

#: Titles in front of a name.
HE = ["Mr", "Herr", "Monsieur", "Señor", "Signor", "господин", "κύριος"]
SHE = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Señora", "Signora", "госпожа", "κυρία"]
ANY = ["Dr", "Prof", "Mx"]

#: What each kind looks like, in the order in which they are tried. Repeats are bounded or cannot backtrack, so a long text cannot run away.
KINDS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]{1,63}+(?:\.[\p{L}\p{N}-]{1,63}+){1,8}",
    "secret": r"(?<=[=:\"'\s])(?<=(?i:token|password|passwd|secret|api_?key)[\"']?\s{0,3}[=:]\s{0,3}[\"']?)(?=[^\s\"']{5}[^\s\"'\p{L}\p{N}]*+[\p{L}\p{N}])(?:[^\s\"'\p{L}\p{N}]*+[\p{L}\p{N}]++)++",
    "access": r"(?<![\p{L}\p{N}_])(?:AKIA|ASIA)[A-Z0-9]{16}(?![\p{L}\p{N}_])|(?<![\p{L}\p{N}_])(?:sk|pk|ghp|gho|xoxb|xoxp)[-_][A-Za-z0-9_-]{16,}+",
    "hex": r"(?<![\p{L}\p{N}_])(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+)(?![\p{L}\p{N}_])",
    "iban": r"(?<![\p{L}\p{N}_])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}_])",
    "ip": r"(?<![\p{N}.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|\d?\d)(?!\d|\.\d)",
    "ssn": r"(?<![\p{L}\p{N}_-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}_-])",
    "card": r"(?<![\p{L}\p{N}_.-])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4})(?![\p{L}\p{N}_])",
    "phone": r"(?<![\p{L}\p{N}_+])(?:(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{3}[ .-])\d{3,4}[ .-]\d{3,4}|\+\d{1,3}[ .-]?\d{2,4}(?:[ .-]?\d{2,4}){2,4})(?!\d)",
    "name": r"(?<![\p{L}])(?:" + "|".join(sorted(HE + SHE + ANY, key=len, reverse=True)) + r")\.? \p{Lu}[\p{Ll}]{1,40}(?:[ -]\p{Lu}[\p{Ll}]{1,40}){0,2}(?![\p{L}])",
}
PATTERN = "|".join(KINDS.values())
#: A text without any of these has no entity; cheap to look for.
HINT = r"[0-9@]|(?i:token|password|passwd|secret|api_?key)|AKIA|ASIA|(?:sk|pk|ghp|gho|xoxb|xoxp)[-_]|[a-f]{32}|[A-F]{32}|" + "|".join(t + r"\.? \p{Lu}" for t in HE + SHE + ANY)

_SYLLABLES = {
    "latin": ["ba", "de", "fi", "go", "lu", "ma", "ne", "ri", "so", "ta", "ve", "jo", "ka", "li", "mo", "pe"],
    "cyrillic": ["ба", "де", "фи", "го", "лу", "ма", "не", "ри", "со", "та", "ве", "жо", "ка", "ли", "мо", "пе"],
    "greek": ["βα", "δε", "φι", "γο", "λυ", "μα", "νε", "ρι", "σο", "τα", "βε", "ζο", "κα", "λι", "μο", "πε"],
}
_ENDINGS = {"latin": ("n", "na", "r"), "cyrillic": ("н", "на", "р"), "greek": ("ς", "να", "ν")}


def _kind(entity: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(KINDS.items()):
        # a lookbehind needs the text before it, which an entity alone has not: what nothing else matches is a secret
        if kind != "secret":
            out = F.when(entity.rlike(f"^(?:{pattern})$"), kind).otherwise(out)
    return F.coalesce(out, F.lit("secret"))


def _byte(stream: Column, i: Column) -> Column:
    """The i-th byte of a hexadecimal text, which is used round and round."""
    return F.conv(F.substring(stream, (i % 64) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _letter(alphabet: str, r: Column) -> Column:
    return F.substring(F.lit(alphabet), r % len(alphabet) + 1, F.lit(1))


def _alike(value: Column, stream: Column) -> Column:
    """Another text of the same form: each character replaced by one of its class."""
    hex_low, hex_up = value.rlike("^[0-9a-f]*$"), value.rlike("^[0-9A-F]*$")

    def other(c: Column, i: Column) -> Column:
        r = _byte(stream, i)
        return (
            F.when(c.rlike(r"^\d$"), F.when(hex_low & value.rlike("[a-f]"), _letter("0123456789abcdef", r)).when(hex_up & value.rlike("[A-F]"), _letter("0123456789ABCDEF", r)).otherwise(_letter("0123456789", r)))
            .when(c.rlike("^[a-z]$"), F.when(hex_low, _letter("0123456789abcdef", r)).otherwise(_letter("abcdefghijklmnopqrstuvwxyz", r)))
            .when(c.rlike("^[A-Z]$"), F.when(hex_up, _letter("0123456789ABCDEF", r)).otherwise(_letter("ABCDEFGHIJKLMNOPQRSTUVWXYZ", r)))
            .when(c.rlike(r"^\p{IsCyrillic}$"), F.when(c.rlike(r"^\p{Lu}$"), _letter("АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЩЭЮЯ", r)).otherwise(_letter("абвгдежзиклмнопрстуфхцчшщэюя", r)))
            .when(c.rlike(r"^\p{IsGreek}$"), F.when(c.rlike(r"^\p{Lu}$"), _letter("ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ", r)).otherwise(_letter("αβγδεζηθικλμνξοπρστυφχψω", r)))
            .when(c.rlike(r"^\p{Lu}$"), _letter("ABCDEFGHIJKLMNOPQRSTUVWXYZ", r))
            .when(c.rlike(r"^\p{L}$"), _letter("abcdefghijklmnopqrstuvwxyz", r))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(value, ""), other), "")


def _luhn_sum(digits: Column) -> Column:
    """Luhn sum of digits that have a check digit behind them."""
    n = F.length(digits)

    def part(c: Column, i: Column) -> Column:
        d = c.cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when((n - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.transform(F.split(digits, ""), part), F.lit(0), lambda a, x: a + x)


def _check_digit(body: Column) -> Column:
    return (10 - _luhn_sum(body) % 10) % 10


def _name(value: Column, kind: Column, stream: Column, attempt: Column) -> Column:
    def built(script: str) -> Column:
        male, female, neutral = _ENDINGS[script]
        ending = F.when(kind.endswith(":he"), male).when(kind.endswith(":she"), female).otherwise(neutral)
        pool = F.array(*map(F.lit, _SYLLABLES[script]))
        syllables = F.transform(F.sequence(F.lit(0), F.lit(2) + attempt), lambda i: F.get(pool, _byte(stream, i) % len(_SYLLABLES[script])))
        return F.initcap(F.concat(F.array_join(syllables, ""), ending))

    return F.when(value.rlike(r"^\p{IsCyrillic}"), built("cyrillic")).when(value.rlike(r"^\p{IsGreek}"), built("greek")).otherwise(built("latin"))


def _drawn(key: str) -> Column:
    """The surrogate of the columns kind and norm, at the draw number ``attempt``."""
    kind, norm, attempt = F.col("kind"), F.col("norm"), F.col("attempt")
    stream = F.sha2(F.concat_ws("\x1f", F.lit(key), kind, norm, attempt.cast("string")).cast("binary"), 512)
    longer = F.array_join(F.transform(F.slice(F.array(*[F.lit(i) for i in range(64, 48, -1)]), 1, F.least(attempt, F.lit(16))), lambda i: _letter("abcdefghijklmnopqrstuvwxyz", _byte(stream, i - 1))), "")
    octet = lambda i, low, n: (_byte(stream, F.lit(i)) % n + low).cast("string")
    tld = F.regexp_extract(norm, r"\.(com|net|org)$", 1)
    body = F.concat(F.substring(norm, 1, 1), _alike(F.expr("substring(norm, 2, length(norm) - 2)"), stream))
    valid = _check_digit(F.expr("left(norm, length(norm) - 1)")).cast("string") == F.expr("right(norm, 1)")
    last = F.when(valid, _check_digit(body)).otherwise((_check_digit(body) + 1 + _byte(stream, F.lit(63)) % 9) % 10).cast("string")
    return (
        F.when(kind == "ip", F.concat_ws(".", octet(0, 240, 15), octet(1, 0, 256), octet(2, 0, 256), octet(3, 1, 254)))
        .when(kind == "card", F.concat(body, last))
        .when(kind == "domain", F.concat(_alike(F.substring_index(norm, ".", 1), stream), longer, F.lit(".example."), F.when(tld == "", "com").otherwise(tld)))
        .when(kind == "email", F.concat(_alike(F.substring_index(norm, "@", 1), stream), longer))
        .when(kind == "secret", F.concat(_alike(norm, stream), longer))
        .when(kind == "access", F.concat(F.regexp_extract(norm, "^(AKIA|ASIA|sk|pk|ghp|gho|xoxb|xoxp)", 1), _alike(F.regexp_replace(norm, "^(AKIA|ASIA|sk|pk|ghp|gho|xoxb|xoxp)", ""), stream)))
        .when(kind == "iban", F.concat(F.substring(norm, 1, 2), _alike(F.expr("substring(norm, 3)"), stream)))
        .when(kind == "phone", F.concat(F.regexp_extract(norm, r"^(\+?\d)", 1), _alike(F.regexp_replace(norm, r"^\+?\d", ""), stream)))
        .when(kind.startswith("name"), _name(norm, kind, stream, attempt))
        .otherwise(_alike(norm, stream))
    )


def _components(entity: Column, kind: Column) -> Column:
    """Array of (kind, norm) of an entity."""
    one = lambda k, n: F.struct(k.alias("kind"), n.alias("norm"))
    digits = F.regexp_replace(entity, r"[^0-9]", "")
    low = F.lower(entity)
    title = F.regexp_replace(F.regexp_extract(entity, r"^(\p{L}+)", 1), r"\.", "")
    gender = F.when(title.isin(HE), "name:he").when(title.isin(SHE), "name:she").otherwise("name:any")
    words = F.filter(F.split(F.regexp_replace(entity, r"^\p{L}+\.? ", ""), "[ -]"), lambda w: w != "")
    return (
        F.when(kind == "email", F.array(one(F.lit("email"), low), one(F.lit("domain"), F.substring_index(low, "@", -1))))
        .when(kind == "name", F.transform(words, lambda w: one(gender, w)))
        .when(kind == "phone", F.array(one(kind, F.concat(F.when(entity.startswith("+"), "+").otherwise(""), digits))))
        .when(kind.isin("card", "ssn"), F.array(one(kind, digits)))
        .when(kind == "iban", F.array(one(kind, F.regexp_replace(entity, " ", ""))))
        .otherwise(F.array(one(kind, entity)))
    )


def _laid_out(entity: Column, plain: Column, char: str) -> Column:
    """The characters of ``plain`` in the places where the entity has characters of the class ``char``."""
    filled = F.transform(
        F.split(entity, ""),
        lambda c, i: F.when(c.rlike(f"^{char}$"), F.substring(plain, F.length(F.regexp_replace(F.substring(entity, F.lit(1), i), f"[^{char[1:-1]}]", "")) + 1, F.lit(1))).otherwise(c),
    )
    return F.array_join(filled, "")


def _rendered() -> Column:
    """The replacement of ``entity`` from the surrogates of its components, in the entity's own layout and case."""
    entity, kind, s = F.col("entity"), F.col("entity_kind"), F.col("surrogates")
    first = F.get(s, F.lit(0))
    title = F.regexp_extract(entity, r"^(\p{L}+\.? )", 1)
    rest = F.regexp_replace(entity, r"^\p{L}+\.? ", "")
    marks = F.regexp_extract_all(rest, F.lit("([ -])"), F.lit(1))
    joined = F.array_join(F.transform(s, lambda w, i: F.concat(w, F.coalesce(F.get(marks, i), F.lit("")))), "")
    plain = (
        F.when(kind == "email", F.concat(first, F.lit("@"), F.get(s, F.lit(1))))
        .when(kind == "name", F.concat(title, joined))
        .when(kind == "phone", _laid_out(entity, F.regexp_replace(first, r"\+", ""), "[0-9]"))
        .when(kind.isin("card", "ssn"), _laid_out(entity, first, "[0-9]"))
        .when(kind == "iban", _laid_out(entity, first, "[A-Z0-9]"))
        .otherwise(first)
    )
    return F.when((kind == "email") & (entity == F.upper(entity)), F.upper(plain)).otherwise(plain)


def assigned(components: DataFrame, key: str) -> DataFrame:
    """kind, norm and surrogate of distinct components (kind, norm); surrogates of a kind are distinct and are no real component."""
    real = stored(components.select("kind", "norm").distinct())
    done: DataFrame | None = None
    left, attempt = real, 0
    while True:
        drawn = left.withColumn("attempt", F.lit(attempt)).select("kind", "norm", _drawn(key).alias("surrogate"))
        first = stored(drawn).groupBy("kind", "surrogate").agg(F.min("norm").alias("norm"))
        good = first.join(real.select("kind", F.col("norm").alias("surrogate")), ["kind", "surrogate"], "left_anti")
        if done is not None:
            good = good.join(done.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        good = stored(good.select("kind", "norm", "surrogate"))
        done = good if done is None else done.unionByName(good)
        left = stored(left.select("kind", "norm").join(good, ["kind", "norm"], "left_anti"))
        if left.isEmpty():
            return done
        attempt += 1


def has_entity(text: Column) -> Column:
    return F.coalesce(text.rlike(HINT) & text.rlike(PATTERN), F.lit(False))


def replaced(documents: DataFrame, key: str) -> DataFrame:
    """The documents with surrogates in their texts, and n_entities. The key is secret: who has it can test a guess."""
    names = [c for c in documents.columns if c != "n_entities"]
    hidden = {c: f"c{i}" for i, c in enumerate(names)}  # own columns never meet those of the caller
    documents = documents.select([F.col(f"`{c}`").alias(h) for c, h in hidden.items()])
    text = F.col(hidden["text"]).cast("string")
    digest = F.md5(text.cast("binary"))
    found = documents.where(has_entity(text)).select(digest.alias("_text"), F.posexplode(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).alias("at", "entity"))
    mentions = stored(found.groupBy("_text", "at").agg(F.first("entity").alias("entity")))
    entities = mentions.groupBy("entity").agg(F.count(F.lit(1)).alias("n")).select("entity", _kind(F.col("entity")).alias("entity_kind"))
    parts = stored(entities.select("entity", "entity_kind", F.posexplode(_components(F.col("entity"), F.col("entity_kind"))).alias("i", "c")).select("entity", "entity_kind", "i", "c.kind", "c.norm"))
    table = assigned(parts, key)
    whole = parts.join(table, ["kind", "norm"]).groupBy("entity", "entity_kind").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "surrogate"))), lambda x: x["surrogate"]).alias("surrogates"))
    replacement = stored(whole.select("entity", _rendered().alias("replacement")))
    per_text = mentions.join(replacement, "entity").groupBy("_text").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "replacement"))), lambda x: x["replacement"]).alias("_new"))
    called = mentions.join(parts.filter(F.col("kind").startswith("name")), "entity").join(table, ["kind", "norm"])
    called = called.groupBy("_text", "norm").agg(F.min_by("surrogate", F.struct("at", "i")).alias("surrogate"))
    called = called.groupBy("_text").agg(F.map_from_entries(F.collect_list(F.struct("norm", "surrogate"))).alias("_called"))  # words of one text
    per_text = per_text.join(called, "_text", "left")
    own = lambda new: [(new if c == "text" else F.col(h)).alias(c) for c, h in hidden.items()]
    pieces = F.split(text, PATTERN, -1)
    words = lambda p: F.regexp_extract_all(p, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    named = lambda p: F.array_join(F.transform(words(p), lambda w: F.coalesce(F.try_element_at("_called", w), w)), "")
    rebuilt = F.array_join(F.transform(pieces, lambda p, i: F.concat(F.when(F.col("_called").isNull(), p).otherwise(named(p)), F.coalesce(F.get(F.col("_new"), i), F.lit("")))), "")
    changed = documents.where(has_entity(text)).withColumn("_text", digest).join(per_text, "_text").select(*own(rebuilt), F.size("_new").cast("bigint").alias("n_entities"))
    return changed.unionByName(documents.where(~has_entity(text)).select(*own(text), F.lit(0).cast("bigint").alias("n_entities")))


def anonymised(documents: DataFrame, key: str) -> DataFrame:
    """The documents with their own columns; a column n_chars follows the new text."""
    whole = documents.select("text", F.struct([F.col(f"`{c}`") for c in documents.columns]).alias("row"))
    out = replaced(whole, key)
    columns = []
    for f in documents.schema.fields:
        own = F.col("row").getField(f.name)
        if f.name == "text":
            own = F.col("text").cast(f.dataType)
        elif f.name == "n_chars":
            own = F.when(F.col("n_entities") > 0, F.length("text").cast(f.dataType)).otherwise(own)
        columns.append(own.alias(f.name))
    return out.select(columns)
