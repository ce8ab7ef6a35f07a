"""Surrogates for personal data: keyed, type-consistent, distinct and the same everywhere.

Entities found in the texts (mail addresses, telephone numbers, IPv4 addresses, card
numbers, access keys and passwords, and names after a form of address) are gathered once over all documents. Each
distinct entity of a type draws a surrogate from a keyed hash: a mail address keeps its
lengths and top domain, a telephone number its country code and punctuation, a card number
its first digit and a valid check digit, a key its alphabet, a name its gender and script. A draw is accepted
if no other entity of its type has it, and if it is not itself an entity of that type in
the corpus; the rest draw again, until all are settled. So distinct entities stay distinct,
and one entity has one surrogate in every document. A name's parts are entities of their
own: where a document has addressed someone by name, the bare name later in the same
document is replaced alike.

Documents without an entity pass by without a shuffle. Everything is DataFrame code.

Defined cases: null and empty texts have no entity and stay; repeated rows are replaced
alike; an empty table gives no rows; any other column is kept whatever its name, but for
``n_entities``, which is replaced. A very long text is one row with its map of names. A number with its
country code and one without are two entities. A value that starts with an unusual or no key stays.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entitynet.session import cut

KEY = "surrogate-key-1"

# Forms of address by gender, and names by gender and script to draw from.
TITLES = {
    "m": ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин"),
    "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа"),
    "u": ("Dr", "Prof"),
}
GIVEN = {
    ("m", "latin"): ("Adam", "Bruno", "Carl", "Daniel", "Edgar", "Felix", "Gustav", "Hugo", "Ivan", "Jonas", "Karl", "Leon", "Martin", "Noel", "Oscar", "Paul"),
    ("f", "latin"): ("Alma", "Berta", "Clara", "Diana", "Elsa", "Flora", "Greta", "Hanna", "Irene", "Julia", "Laura", "Marta", "Nina", "Olga", "Paula", "Rosa"),
    ("u", "latin"): ("Alex", "Chris", "Dominique", "Kim", "Lou", "Maxime", "Noa", "Robin", "Sam", "Toni"),
    ("m", "cyrillic"): ("Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Игорь", "Павел"),
    ("f", "cyrillic"): ("Анна", "Вера", "Галина", "Дарья", "Елена", "Ирина", "Мария", "Ольга"),
    ("u", "cyrillic"): ("Женя", "Саша", "Валя", "Слава"),
}
FAMILY = {
    "latin": ("Adler", "Baker", "Castro", "Duval", "Engel", "Fischer", "Garnier", "Herrera", "Irving", "Jansen", "Keller", "Lambert", "Moreno", "Norris",
              "Ortega", "Perrin", "Quinn", "Romero", "Sommer", "Turner", "Urban", "Vidal", "Weber", "York", "Zimmer"),
    "cyrillic": ("Белов", "Волков", "Громов", "Зайцев", "Козлов", "Лебедев", "Морозов", "Новиков", "Орлов", "Соколов"),
}
MAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])"
PHONE = r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\w)"
ADDRESS = r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\w]|\.\d)"
CARD = r"(?<![\w.-])\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?![\w-])"
PART = r"\p{Lu}[\p{L}'’-]{1,40}"
#: A number without its country code, as (614) 555-8001 or 614-555-8001.
NATIONAL = r"(?<![\w(+.-])(?:\([2-9]\d{2}\) ?|[2-9]\d{2}[.-])\d{3}[.-]\d{4}(?![\w-]|\.\d)"
# What a secret is called.
SECRET_KEYS = r"(?i:password|passwd|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key)"
#: Four letters or digits at least, so masks such as ****** are none, and not the name of a key itself.
_REAL = rf"(?=(?:[^\s\"'A-Za-z0-9]*+[A-Za-z0-9]){{4}})(?!{SECRET_KEYS}\b)"
#: After a key: a quoted value, one right behind an equals sign that is no call or index, or any with a digit.
#: One character behind and the value itself are looked at first: the keys are tried at few places then.
_BARE = r"[^\s\"'<>,;&()\[\]{}]"
SECRET = "|".join((
    r"(?<!\w)AKIA[0-9A-Z]{16}(?!\w)",
    rf"(?<=[\"']){_REAL}(?<={SECRET_KEYS}[\"']?[ \t]{{0,3}}[:=][ \t]{{0,3}}[\"'])[^\s\"']{{6,}}+(?=[\"'])",
    rf"(?<==){_REAL}(?<={SECRET_KEYS}=){_BARE}{{6,}}+(?![(\[{{])",
    rf"(?<=[:= \t])(?=[^\s\"'<>,;&()\[\]{{}}\d]*+\d){_REAL}(?<={SECRET_KEYS}[ \t]{{0,3}}[:=][ \t]{{0,3}}){_BARE}{{6,}}+(?![(\[{{])",
))
TITLED = r"(?<!\p{L})(?:" + "|".join(t for g in TITLES.values() for w in g for t in (w, w.upper())) + rf")\.? {PART}(?: {PART})?"
ENTITY = "|".join((MAIL, PHONE, ADDRESS, NATIONAL, SECRET, CARD, TITLED))
#: What a text is cut at to be put together again: the entities and every word that could be part of a name.
PIECE = "|".join((MAIL, PHONE, ADDRESS, NATIONAL, SECRET, CARD, rf"(?<!\p{{L}}){PART}"))


def kind_of(value: Column) -> Column:
    """The type of an entity; null for a form of address with a name, which alone holds a blank beside numbers."""
    whole = lambda pattern: value.rlike(f"^(?:{pattern})$")
    return (F.when(whole(MAIL), "mail").when(whole(PHONE) | whole(NATIONAL), "phone").when(whole(ADDRESS), "ip")
            .when(whole(CARD), "card").when(~value.contains(" "), "secret"))


def may_hold_any(text: Column) -> Column:
    """Every entity needs a digit, a mail sign, a form of address or the name of a secret: texts without are passed over quickly."""
    titles = sorted({t for g in TITLES.values() for w in g for t in (w, w.upper())}, key=len)
    stems = [t for i, t in enumerate(titles) if not any(t.startswith(u) for u in titles[:i])]
    return F.coalesce(reduce(lambda a, t: a | text.contains(t), stems, text.rlike("[0-9@]")) | text.rlike(SECRET_KEYS), F.lit(False))


def entities(text: Column) -> Column:
    """Distinct structs (kind, norm, shown) of a text: type, the entity itself, and how it is written."""
    every = F.regexp_extract_all(text, F.lit(f"({ENTITY})"), 1)
    plain = F.transform(F.filter(every, lambda x: kind_of(x).isNotNull()), lambda x: F.array(F.struct(
        kind_of(x).alias("kind"), F.when(kind_of(x) == "mail", F.lower(x)).when(kind_of(x).isin("ip", "secret"), x).otherwise(F.regexp_replace(x, r"[^\d+]", "")).alias("norm"), x.alias("shown"))))

    def parts(x: Column) -> Column:
        title = F.regexp_extract(x, r"^\p{L}+", 0)
        words = F.split(F.regexp_replace(x, r"^\p{L}+\.? ", ""), " ")
        of = lambda g: title.isin(*[t for w in TITLES[g] for t in (w, w.upper())])
        gender = F.when(of("m"), "m").when(of("f"), "f").otherwise("u")
        script = F.when(words[0].rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")
        return F.transform(words, lambda w, i: F.struct(F.concat(
            F.when((i == 0) & (F.size(words) > 1), F.concat(F.lit("given-"), gender)).otherwise(F.lit("family")), F.lit("-"), script).alias("kind"),
            w.alias("norm"), w.alias("shown")))

    names = F.transform(F.filter(every, lambda x: kind_of(x).isNull()), parts)
    return F.array_distinct(F.flatten(F.concat(plain, names)))


def draw(kind: Column, norm: Column, attempt: int, key: str = KEY) -> Column:
    """The surrogate of an entity's ``attempt``-th draw, decided by key, type and entity alone."""
    stream = F.array_join(F.transform(F.sequence(F.lit(0), (F.length(norm) / 32).cast("int")), lambda b: F.sha2(
        F.concat_ws("|", F.lit(key), kind, norm, F.lit(attempt), b), 256)), "")
    number = lambda i: F.conv(F.substring(stream, (i * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int")
    letters, stop = F.lit("abcdefghijklmnopqrstuvwxyz"), F.length(F.regexp_extract(norm, r"\.[a-z]+$", 0))
    spelled = lambda f: F.array_join(F.transform(F.split(norm, ""), f), "")
    mail = spelled(lambda c, i: F.when(i >= F.length(norm) - stop, c).when(c.rlike("[a-z]"), F.substring(letters, number(i) % 26 + 1, F.lit(1)))
                   .when(c.rlike(r"\d"), (number(i) % 10).cast("string")).otherwise(c))
    # The country code stays with its sign; digits of 2 and more stay so, which keeps area codes and exchanges possible.
    phone = spelled(lambda c, i: F.when(((i <= 1) & norm.startswith("+")) | ~c.rlike(r"\d"), c).when(c >= "2", (number(i) % 8 + 2).cast("string")).otherwise((number(i) % 2).cast("string")))
    octet = lambda i, of, least: (number(F.lit(i)) * 256 + number(F.lit(i + 8))) % of + least
    address = F.concat_ws(".", octet(0, 89, 11), octet(1, 254, 1), octet(2, 254, 1), octet(3, 254, 1))
    # A key keeps its marker and its punctuation; hexadecimal stays hexadecimal.
    span = F.when(norm.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), 6).otherwise(26)
    secret = spelled(lambda c, i: F.when((i < 4) & norm.startswith("AKIA"), c).when(c.rlike(r"\d"), (number(i) % 10).cast("string")).when(
        c.rlike("[A-Z]"), F.upper(F.substring(letters, number(i) % span + 1, F.lit(1)))).when(
        c.rlike(r"\p{L}"), F.substring(letters, number(i) % span + 1, F.lit(1))).otherwise(c))
    digits = spelled(lambda c, i: F.when(i == 0, c).otherwise((number(i) % 10).cast("string")))
    body = F.substring(digits, F.lit(1), F.length(norm) - 1)
    luhn = F.aggregate(F.transform(F.reverse(F.split(body, "")), lambda c, i: F.when(i % 2 == 1, c.cast("int")).otherwise(
        c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0))), F.lit(0), lambda s, x: s + x)
    card = F.concat(body, ((10 - luhn % 10) % 10).cast("string"))
    #: After a few draws from a short list, two and then more names are joined.
    joined = attempt // 3 + 1
    names = F.lit(None).cast("string")
    pools = {f"given-{g}-{s}": pool for (g, s), pool in GIVEN.items()} | {f"family-{s}": pool for s, pool in FAMILY.items()}
    wide = F.sha2(F.concat_ws("|", F.lit(key), kind, norm, F.lit(attempt), F.lit("name")), 256)
    for name, pool in pools.items():
        one = lambda j, pool=pool: F.element_at(F.array(*map(F.lit, pool)), (F.conv(F.substring(wide, 4 * (j % 16) + 1, 4), 16, 10).cast("int") % len(pool) + 1))
        names = F.when(kind == name, F.concat_ws("-", *[one(j) for j in range(joined)])).otherwise(names)
    return F.when(kind == "mail", mail).when(kind == "phone", phone).when(kind == "ip", address).when(kind == "card", card).when(kind == "secret", secret).otherwise(names)


def settle(found: DataFrame, key: str = KEY) -> DataFrame:
    """(kind, norm, surrogate): distinct surrogates of the distinct entities (kind, norm)."""
    pending, settled, attempt = found, None, 0
    while not pending.isEmpty():
        drawn = cut(pending.withColumn("surrogate", draw(F.col("kind"), F.col("norm"), attempt, key)))
        first = cut(drawn.groupBy("kind", "surrogate").agg(F.min("norm").alias("norm")))
        free = first.join(found.select("kind", F.col("norm").alias("surrogate")), ["kind", "surrogate"], "left_anti")
        if settled is not None:
            free = free.join(settled.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        won = cut(free.select("kind", "norm", "surrogate"))
        settled = won if settled is None else cut(settled.unionByName(won))
        pending = cut(pending.join(won.select("kind", "norm"), ["kind", "norm"], "left_anti"))
        attempt += 1
    return settled if settled is not None else found.withColumn("surrogate", F.lit(None).cast("string"))


def written(kind: Column, shown: Column, surrogate: Column) -> Column:
    """The surrogate with the punctuation and the capitals of what it replaces."""
    digits = F.regexp_replace(shown, r"[^\d+]", "")
    # The n-th digit of the written form takes the n-th character of the surrogate.
    numbered = F.aggregate(F.split(shown, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("n")), lambda s, c: F.when(
        c.rlike(r"[\d+]"), F.struct(F.concat(s.out, F.substring(surrogate, s.n, F.lit(1))).alias("out"), (s.n + 1).alias("n"))).otherwise(
        F.struct(F.concat(s.out, c).alias("out"), s.n.alias("n")))).out
    cased = F.array_join(F.transform(F.split(shown, ""), lambda c, i: F.when(
        F.upper(c) == c, F.upper(F.substring(surrogate, i + 1, F.lit(1)))).otherwise(F.substring(surrogate, i + 1, F.lit(1)))), "")
    return (F.when(kind.isin("phone", "card") & (digits != shown), numbered).when((kind == "mail") & (F.lower(shown) != shown), cased)
            .when(kind.rlike("^(given|family)") & (F.upper(shown) == shown) & (F.length(shown) > 1), F.upper(surrogate)).otherwise(surrogate))


def replaced(text: Column, names: Column) -> Column:
    """``text`` with every piece that ``names`` (written form to surrogate) knows replaced."""
    pieces = F.regexp_extract_all(text, F.lit(f"({PIECE})"), 1)
    between = F.split(text, PIECE, -1)
    return F.array_join(F.transform(F.arrays_zip(between.alias("b"), pieces.alias("p")), lambda x: F.concat(
        F.coalesce(x.b, F.lit("")), F.coalesce(names[x.p], x.p, F.lit("")))), "")


def replace_entities(docs: DataFrame, key: str = KEY) -> DataFrame:
    """The columns of ``docs``, text replaced, and n_entities, how many distinct written entities each document has."""
    taken = {c.lower() for c in docs.columns}
    free = lambda name: name if name not in taken else free("_" + name)
    row, marks, told = free("_row"), free("_entities"), free("_names")
    columns = [f"`{c}`" for c in docs.columns if c.lower() != "n_entities"]
    none = F.array().cast("array<struct<kind:string,norm:string,shown:string>>")
    marked = docs.withColumn(marks, F.when(may_hold_any(F.col("text")), entities(F.col("text"))).otherwise(none))
    plain = marked.where(F.size(marks) == 0)
    private = cut(marked.where(F.size(marks) > 0).withColumn(row, F.monotonically_increasing_id()))
    each = private.select(row, F.explode(marks).alias("e")).select(row, "e.*")
    names = settle(cut(each.select("kind", "norm").distinct()), key)
    # A word that a document shows both as a given and as a family name takes one of the two surrogates.
    one = each.join(names, ["kind", "norm"]).groupBy(row, "shown").agg(F.min_by("surrogate", "kind").alias("surrogate"), F.min("kind").alias("kind"))
    found = one.groupBy(row).agg(F.map_from_entries(F.collect_list(F.struct(
        "shown", written(F.col("kind"), F.col("shown"), F.col("surrogate"))))).alias(told))
    done = private.join(found, row).withColumn("text", replaced(F.col("text"), F.col(told)))
    count = F.size(marks).cast("long").alias("n_entities")
    return plain.select(*columns, count).unionByName(done.select(*columns, count))
