"""Surrogates for personal data, in DataFrame functions only.

One Java regular expression finds the entities of a text; splitting the text at it gives what lies between, so that each
text is rebuilt in one pass. Digits of phone numbers, cards, account numbers and addresses go through a keyed
Feistel network over the digits themselves: a bijection per kind and length, so distinct values cannot meet and equal values agree
everywhere. E-mail addresses, names and secrets get keyed letters of the same script and case. These could collide, so
the distinct values of the corpus are checked, and values that would share a surrogate with another value, or whose surrogate
is itself a value of the corpus, are drawn again until none does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

TITLES_F = ("Mrs", "Ms", "Miss", "Frau", "Mme", "Mlle", "Madame", "Señora", "Señorita", "Sra", "Srta")
TITLES_M = ("Mr", "Herr", "Herrn", "Monsieur", "Señor", "Sr")
#: Kind, pattern. The order is the precedence at one position.
KINDS = (
    ("email", r"(?<![\p{L}\p{N}])[\p{L}\p{N}][\p{L}\p{N}._%+\-]{0,63}@(?:[A-Za-z0-9](?:[A-Za-z0-9\-]{0,62})\.){1,8}[A-Za-z]{2,24}"),
    ("secret", r"(?<![\p{L}\p{N}])(?:[0-9a-f]{32,64}|sk-[A-Za-z0-9]{20,64}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36})(?![\p{L}\p{N}])"),
    ("iban", r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?=(?:[ A-Z]*[0-9]){9})(?: ?[0-9A-Z]{4}){3,6}(?: ?[0-9A-Z]{1,3})?(?![\p{L}\p{N}])"),
    ("ip", r"(?<![\p{L}\p{N}.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?!\.?[\p{L}\p{N}])"),
    ("card", r"(?<![\p{L}\p{N}])(?:[0-9]{13,19}|[0-9]{4}(?:[ \-][0-9]{4}){3})(?![\p{L}\p{N}])"),
    ("ssn", r"(?<![\p{L}\p{N}\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}\-])"),
    ("phone", r"(?<![\p{L}\p{N}+])(?:\+[0-9]{1,3}[ .\-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .\-]?[0-9]{2,4}){2,3}|\([0-9]{3}\) ?[0-9]{3}[ .\-][0-9]{4}|[0-9]{3}[.\-][0-9]{3}[.\-][0-9]{4})(?![\p{L}\p{N}])"),
    ("name", r"(?<![\p{L}\p{N}])(?:" + "|".join(TITLES_F + TITLES_M) + r")\.? \p{Lu}\p{Ll}{1,30}(?:[ \-]\p{Lu}\p{Ll}{1,30}){0,2}(?![\p{L}\p{N}])"),
)
ANY = "|".join(f"(?:{p})" for _, p in KINDS)
LETTERS = "abcdefghijklmnopqrstuvwxyz"
CYRILLIC = "абвгдежзиклмнопрстуфхцчшэюя"[:26]
GREEK = "αβγδεζηθικλμνξοπρστυφχψωάή"[:26]
ROUNDS = 6


def kind_of(e: Column) -> Column:
    out = F.lit("name")
    for kind, pattern in reversed(KINDS[:-1]):
        out = F.when(F.regexp_like(e, F.lit(f"^(?:{pattern})$")), kind).otherwise(out)
    return out


def _hash(key: str, *parts: Column | str) -> Column:
    """64 hex digits that depend on the key and the parts."""
    return F.sha2(F.concat_ws("\x1f", F.lit(key), *[F.lit(p) if isinstance(p, str) else p for p in parts]), 256)


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _pow10(n: Column) -> Column:
    return F.pow(F.lit(10.0), n).cast("long")


def permute_digits(digits: Column, key: str, kind: Column | str) -> Column:
    """A keyed bijection of the digit strings of each length from 2 to 36: alternating Feistel rounds in decimal."""
    return _let(digits, lambda d: _permuted(d, key, kind))


def _permuted(digits: Column, key: str, kind: Column | str) -> Column:
    u = F.floor(F.length(digits) / 2).cast("int")
    v = (F.length(digits) - u).cast("int")
    start = F.struct(F.substr(digits, F.lit(1), u).alias("a"), F.substr(digits, u + 1, v).alias("b"))

    def turn(r: int):
        m = u if r % 2 == 0 else v

        def step(s):
            f = F.conv(F.substring(_hash(key, kind, str(r), s["b"]), 1, 15), 16, 10).cast("decimal(20,0)")
            c = ((s["a"].cast("decimal(20,0)") + f) % _pow10(m)).cast("decimal(20,0)").cast("string")
            return F.struct(s["b"].alias("a"), F.lpad(c, m, "0").alias("b"))

        return step

    state = start
    for r in range(ROUNDS):
        state = _let(state, turn(r))
    return _let(state, lambda s: F.concat(s["a"], s["b"]))


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of digits before their check digit, 0 to 9."""
    one = lambda c, i: c.cast("int") * (F.when(i % 2 == 0, 2).otherwise(1))
    parts = F.transform(F.split(F.reverse(digits), ""), one)
    return F.aggregate(parts, F.lit(0), lambda s, x: s + x % 10 + F.floor(x / 10).cast("int")) % 10


def _refill(template: Column, chars: Column) -> Column:
    """The template with its digits replaced one after another by ``chars``."""
    fill = lambda d: F.aggregate(
        F.split(template, ""), F.struct(F.lit("").alias("o"), F.lit(1).alias("k")),
        lambda s, c: F.when(c.between("0", "9"), F.struct(F.concat(s["o"], F.substr(d, s["k"], F.lit(1))).alias("o"), (s["k"] + 1).alias("k"))).otherwise(F.struct(F.concat(s["o"], c).alias("o"), s["k"].alias("k"))),
        lambda s: s["o"],
    )
    return _let(chars, fill)


def _reletter(word: Column, stream: Column) -> Column:
    """Each letter and digit of ``word`` replaced by one drawn from the hex ``stream``; script, case and the rest stay."""
    def one(h, c, i):
        n = F.conv(F.substr(h, (i * 2) % 60 + 1, F.lit(4)), 16, 10).cast("int") + i
        pick = lambda alphabet: F.substr(F.lit(alphabet), n % len(alphabet) + 1, F.lit(1))
        low = F.when(F.regexp_like(c, F.lit(r"\p{IsCyrillic}")), pick(CYRILLIC)).when(F.regexp_like(c, F.lit(r"\p{IsGreek}")), pick(GREEK)).otherwise(pick(LETTERS))
        out = F.when(F.regexp_like(c, F.lit(r"\p{Lu}")), F.upper(low)).otherwise(low)
        return F.when(F.regexp_like(c, F.lit(r"[0-9]")), (n % 10).cast("string")).when(F.regexp_like(c, F.lit(r"\p{L}")), out).otherwise(c)

    return _let(stream, lambda h: F.array_join(F.transform(F.split(word, ""), lambda c, i: one(h, c, i)), ""))


def _name_word(word: Column, female: Column, key: str, attempt: Column) -> Column:
    """A name of keyed syllables: in the script of ``word``, ending in a vowel for a female title and else in a consonant."""
    h = _hash(key, "name", F.lower(word), attempt.cast("string"))

    def build(h):
        at = lambda i, alphabet: F.substr(F.lit(alphabet), F.conv(F.substring(h, 1 + 4 * i, 4), 16, 10).cast("int") % len(alphabet) + 1, F.lit(1))
        syllables = [x for i in range(4) for x in (at(2 * i, "bdfgklmnprstvz"), at(2 * i + 1, "aeiou"))]
        return F.initcap(F.concat(*syllables, F.when(female, F.lit("")).otherwise(at(9, "nrsltk"))))

    latin = _let(h, build)
    return F.when(F.regexp_like(word, F.lit(r"\p{IsCyrillic}")), F.translate(latin, "abdefgiklmnoprstuvzABDEFGIKLMNOPRSTUVZ", "абдефгиклмнопрстувзАБДЕФГИКЛМНОПРСТУВЗ")).otherwise(latin)


def normal(e: Column, kind: Column) -> Column:
    """What counts as one value: letter case does not matter in addresses, separators not in numbers."""
    return F.when(kind == "email", F.lower(e)).when(kind.isin("card", "ssn", "phone", "iban"), F.regexp_replace(e, r"[ .()\-]", "")).otherwise(e)


def surrogate(e: Column, kind: Column, key: str, attempt: Column, hashed_only: bool = False) -> Column:
    """The replacement of one entity. ``attempt`` is 0 but for the values that the collision check drew again."""
    digits = F.regexp_replace(e, r"[^0-9]", "")
    draw = attempt.cast("string")
    local, domain = F.substring_index(e, "@", 1), F.lower(F.substring_index(e, "@", -1))
    tail = F.substring_index(domain, ".", -1)
    host = _let(_hash(key, "domain", domain), lambda h: F.concat(F.lit("m"), F.translate(F.substring(h, 1, 9), "0123456789", "ghijklmnop"), F.lit(".example."), F.when(tail.isin("com", "net", "org"), tail).otherwise("org")))
    # each further draw is two letters longer, so that short addresses cannot run out of surrogates
    longer = _let(_hash(key, "longer", F.lower(e), draw), lambda h: F.translate(F.substr(h, F.lit(1), F.least(2 * attempt, F.lit(40))), "0123456789", "ghijklmnop"))
    email = F.concat(_reletter(F.lower(local), _hash(key, "email", F.lower(e), draw)), longer, F.lit("@"), host)
    body = F.regexp_extract(e, r"^(?:sk-|AKIA|gh[pousr]_)?", 0)
    secret = F.when(F.regexp_like(e, F.lit("^[0-9a-f]+$")), F.substr(_hash(key, "secret", e, draw), F.lit(1), F.length(e))).otherwise(F.concat(body, _reletter(F.substr(e, F.length(body) + 1), _hash(key, "secret", e, draw))))
    title = F.regexp_extract(e, r"^\p{L}+\.? ", 0)
    female = F.regexp_extract(e, r"^\p{L}+", 0).isin(*TITLES_F)
    words = F.transform(F.split(F.substr(e, F.length(title) + 1), "[ \\-]"), lambda w: _name_word(w, female, key, attempt))
    gaps = F.concat(F.regexp_extract_all(F.substr(e, F.length(title) + 1), F.lit("[ \\-]"), F.lit(0)), F.array(F.lit("")))
    name = F.concat(title, F.array_join(F.zip_with(words, gaps, lambda w, g: F.concat(w, g)), ""))
    hashed = F.when(kind == "email", email).when(kind == "secret", secret)
    if hashed_only:
        return hashed.otherwise(name)
    octets = F.transform(F.split(e, r"\."), lambda x: x.cast("int"))

    def mix16(r: int):
        return lambda s: F.struct(s["b"].alias("a"), s["a"].bitwiseXOR(F.conv(F.substring(_hash(key, "ip", str(r), s["b"].cast("string")), 1, 4), 16, 10).cast("int")).alias("b"))

    def feistel16(o):
        state = F.struct((F.get(o, F.lit(0)) * 256 + F.get(o, F.lit(1))).alias("a"), (F.get(o, F.lit(2)) * 256 + F.get(o, F.lit(3))).alias("b"))
        for r in range(4):
            state = _let(state, mix16(r))
        return _let(state, lambda s: F.concat_ws(".", *[x.cast("int").cast("string") for x in (F.floor(s["a"] / 256), s["a"] % 256, F.floor(s["b"] / 256), s["b"] % 256)]))

    ip = _let(octets, feistel16)

    def card_digits(d):
        head = F.substr(d, F.lit(1), F.length(d) - 1)
        return _let(permute_digits(head, key, "card"), lambda p: F.concat(p, ((F.substr(d, F.length(d), F.lit(1)).cast("int") + luhn_sum(head) - luhn_sum(p) + 10) % 10).cast("string")))

    # a leading + and the first digit of the country code stay; what follows is one number, however it is written
    code = F.regexp_extract(e, r"^\+[0-9]", 0)
    rest = F.substr(e, F.length(code) + 1)
    phone = F.concat(code, _refill(rest, permute_digits(F.regexp_replace(rest, r"[^0-9]", ""), key, F.concat(F.lit("phone"), code))))
    iban = F.concat(F.substring(e, 1, 2), _refill(F.substr(e, F.lit(3)), permute_digits(digits, key, F.concat(F.lit("iban"), F.substring(e, 1, 2)))))
    hashed = hashed.when(kind == "ip", ip).when(kind == "card", _refill(e, _let(digits, card_digits)))
    return hashed.when(kind == "ssn", _refill(e, permute_digits(digits, key, "ssn"))).when(kind == "phone", phone).when(kind == "iban", iban).otherwise(name)


def _found(text: Column) -> Column:
    """The entities of a text in order; texts without @, a digit or a title are not searched."""
    return F.when(F.regexp_like(text, F.lit(r"[0-9@]|\b(?:" + "|".join(TITLES_F + TITLES_M) + r")\b")), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))


def _collisions(values: DataFrame, key: str, rounds: int = 60) -> DataFrame:
    """``(kind, norm, attempt)`` of the values that must be drawn again; ``values`` has distinct ``(kind, norm)``.

    Only kinds whose surrogates are hashed take part; the others are bijections. Values that still collide after
    ``rounds`` draws are an error, not a result.
    """
    values = cut(values.where(F.col("kind").isin("email", "secret", "name")).withColumn("attempt", F.lit(0)), "values")
    moved = values.where("false")
    fresh = values
    for _ in range(rounds):
        drawn = values.join(moved.withColumnRenamed("attempt", "later"), ["kind", "norm"], "left").withColumn("attempt", F.coalesce("later", "attempt")).drop("later")
        drawn = drawn.withColumn("out", F.lower(surrogate(F.col("norm"), F.col("kind"), key, F.col("attempt"), hashed_only=True)))
        shared = drawn.groupBy("kind", "out").agg(F.count("*").alias("n"), F.min("norm").alias("first")).where("n > 1")
        clash = drawn.join(shared, ["kind", "out"]).where("norm <> first").select("kind", "norm", "attempt")
        real = drawn.join(values.select("kind", F.lower("norm").alias("out")).distinct(), ["kind", "out"], "left_semi").select("kind", "norm", "attempt")
        fresh = cut(clash.union(real).distinct(), "clash")
        if fresh.isEmpty():
            return moved
        again = fresh.withColumn("attempt", F.col("attempt") + 1)
        moved = cut(moved.join(again, ["kind", "norm"], "left_anti").union(again), "moved")
    raise ValueError(f"surrogates still collide after {rounds} draws")


def _bare(gap: Column, words: Column, new: Column) -> Column:
    """The gap with later mentions of the ``words`` of titled names replaced, in one pass, by those of the map ``new``."""
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}])(?:"), F.array_join(words, "|"), F.lit(r")(?![\p{L}\p{N}])"))
    between, mentions = F.split(gap, pattern, -1), F.regexp_extract_all(gap, pattern, F.lit(0))
    return _let(between, lambda b: F.concat(F.array_join(F.zip_with(F.slice(b, F.lit(1), F.size(b) - 1), mentions, lambda g, m: F.concat(g, F.element_at(new, m))), ""), F.element_at(b, -1)))


def surrogates(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``text_col`` rewritten and ``n_entities`` and ``entity_kinds`` (sorted, distinct) added.

    Supported forms are those of ``KINDS``; a person is found by a title, and the words of the name are then replaced wherever the document
    has them. ``n_entities`` does not count these bare mentions. Every input row comes out once, in any number of repeats. Null texts stay null, empty ones empty; both have 0 entities.
    An empty table gives an empty result. Columns of ``docs`` named like the two new ones are replaced, other names do not matter.
    The key decides all draws; one key gives one surrogate per value over all tables and runs.
    """
    kept = [c for c in docs.columns if c not in ("n_entities", "entity_kinds")]
    found, made, row, again, gone = (next(f"{x}{'_' * k}" for k in range(len(kept) + 2) if f"{x}{'_' * k}" not in kept) for x in ("__found", "__new", "__row", "__again", "__names"))
    entities = docs.select(F.explode(F.array_distinct(_found(F.col(text_col)))).alias("e"))
    typed = entities.select("e", kind_of(F.col("e")).alias("kind")).select("kind", normal(F.col("e"), F.col("kind")).alias("norm"))
    moved = cut(_collisions(typed.distinct(), key), "moved")
    df = docs.select(*kept, F.coalesce(_found(F.col(text_col)), F.array().cast("array<string>")).alias(found))
    if moved.isEmpty():
        attempt = lambda kind, e: F.lit(0)
    else:
        # the few values that were drawn again go to the rows that hold them
        df = cut(df.withColumn(row, F.monotonically_increasing_id()), "rows")
        held = df.select(row, F.explode(F.array_distinct(found)).alias("e")).withColumn("kind", kind_of(F.col("e"))).withColumn("norm", normal(F.col("e"), F.col("kind")))
        maps = held.join(moved, ["kind", "norm"]).groupBy(row).agg(F.map_from_entries(F.collect_set(F.struct(F.concat_ws("\x1f", "kind", "norm"), "attempt"))).alias(again))
        df = df.join(maps, row, "left")
        attempt = lambda kind, e: F.coalesce(F.try_element_at(again, F.concat_ws("\x1f", kind, normal(e, kind))), F.lit(0))
    new = F.transform(found, lambda e: _let(kind_of(e), lambda k: F.struct(k.alias("k"), e.alias("e"), surrogate(e, k, key, attempt(k, e)).alias("s"))))
    new = F.when(F.size(found) > 0, new).otherwise(F.array().cast("array<struct<k:string,e:string,s:string>>"))
    df = df.select(*kept, found, new.alias(made))
    # word -> surrogate word of the names in a text; the first titled mention of a word decides
    split = lambda x: F.slice(F.split(x, "[ \\-]"), F.lit(2), F.lit(9))
    pairs = F.flatten(F.transform(F.filter(made, lambda n: n["k"] == "name"), lambda n: F.arrays_zip(split(n["e"]).alias("w"), split(n["s"]).alias("s"))))
    firsts = F.aggregate(
        pairs, F.create_map().cast("map<string,string>"),
        lambda m, p: F.when(F.map_contains_key(m, p["w"]), m).otherwise(F.map_concat(m, F.create_map(p["w"], p["s"]))),
    )
    df = df.select(*kept, found, made, F.when(F.exists(made, lambda n: n["k"] == "name"), firsts).alias(gone))
    gaps = F.split(F.col(text_col), ANY, -1)
    gaps = F.when(F.col(gone).isNull(), gaps).otherwise(F.transform(gaps, lambda g: _bare(g, F.array_sort(F.map_keys(gone), lambda x, y: F.length(y) - F.length(x)), F.col(gone))))
    joined = _let(gaps, lambda all_: F.concat(F.array_join(F.zip_with(F.slice(all_, F.lit(1), F.size(found)), made, lambda g, n: F.concat(g, n["s"])), ""), F.element_at(all_, -1)))
    text = F.when(F.size(found) > 0, joined).otherwise(F.col(text_col)).alias(text_col)
    kinds = F.array_sort(F.array_distinct(F.transform(made, lambda n: n["k"])))
    return df.select(*[text if c == text_col else c for c in kept], F.size(found).cast("long").alias("n_entities"), kinds.alias("entity_kinds"))
