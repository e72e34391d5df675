"""Personal data: detected entities are replaced by keyed surrogates of the same kind and form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradebook.sources.checkpoints import checkpointed, written_once

# What counts as an entity, tried in this order at each place of a text.
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_HEX = r"[0-9a-f]{40}(?:[0-9a-f]{24})?|[0-9a-f]{32}|[0-9A-F]{40}(?:[0-9A-F]{24})?|[0-9A-F]{32}"
_KEY = (
    r"eyJ[A-Za-z0-9_\-]{8,}\.eyJ[A-Za-z0-9_\-]{4,}\.[A-Za-z0-9_\-]{10,}|sk-[A-Za-z0-9_\-]{20,}|[rs]k_(?:live|test)_[A-Za-z0-9]{16,}"
    r"|xox[abeoprs]-[A-Za-z0-9\-]{10,}|AIza[A-Za-z0-9_\-]{35}|glpat-[A-Za-z0-9_\-]{20,}|github_pat_[A-Za-z0-9_]{22,}")
#: What a key of each kind starts with; it stays.
_START = r"^(?:A[KS]IA|gh[pousr]_|eyJ|sk-|[rs]k_(?:live|test)_|xox[abeoprs]-|AIza|glpat-|github_pat_)"
_GROUP = "[0-9A-Fa-f]{1,4}"
_GAP = r"(?:[ \-./]|[ \-./]?\(|\)[ \-./]?)?"
_DATE = r"0[1-9][ \-./][0-3][0-9][ \-./](?:19|20)?[0-9]{2}(?![ \-.]?[0-9])"
_TITLE = (
    r"(?:Mrs?|Ms|Miss|Mx|Dr|Prof|Herrn?|Frau|Monsieur|Madame|Mademoiselle|Mme|Mlle|Maître|Señora?|Señorita|Srta|Sra?|Dra|Profa|Don|Doña|г-н|г-жа)\.?"
    r"|(?:M|Me)\.")
# Repeated groups give nothing back or are bounded, so that a word of any length is searched without recursion.
_NAME = r"(?:\p{Lu}['’])?\p{Lu}\p{Ll}++(?:\p{Lu}\p{Ll}++)*+(?:[\-'’]\p{Lu}\p{Ll}++)*+"
_NAMES = rf"(?:\p{{Lu}}\. ){{0,6}}{_NAME}(?: (?:(?:von|van|vom|zu|zur|de|der|den|du|la|las|los|del|di|y) )*(?:{_NAME}|\p{{Lu}}\.(?= \p{{Lu}}))){{0,4}}"
_TITLES = rf"^(?:(?:{_TITLE}) (?:(?:Dr|Prof)\.? ){{0,6}})?"
_INTRODUCED = r"[Mm]y name is|[Ii]ch hei(?:ß|ss)e|[Mm]ein Name ist|[Jj]e m['’]appelle|[Mm]on nom est|[Mm]e llamo|[Mm]i nombre es|(?:[Nn]ame|[Nn]om|[Nn]ombre):"
PATTERNS = {
    "email": r"[\p{L}0-9](?:[\p{L}0-9._%+\-]{0,62}[\p{L}0-9_%+\-])?@(?:[\p{L}0-9](?:[\p{L}0-9\-]{0,61}[\p{L}0-9])?\.){1,8}\p{L}{2,24}",
    "block": r"-----BEGIN (?:[A-Z0-9]+ ){0,3}PRIVATE KEY(?: BLOCK)?-----[^\-]*+(?:-(?!----END )[^\-]*+)*+-----END (?:[A-Z0-9]+ ){0,3}PRIVATE KEY(?: BLOCK)?-----",
    "secret": rf"(?<![A-Za-z0-9])(?:A[KS]IA[0-9A-Z]{{16}}|gh[pousr]_[A-Za-z0-9]{{36}}|{_HEX}|{_KEY})(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<![0-9])(?:[0-9]{16}|[0-9]{4}(?:[ \-][0-9]{4}){3}(?:[ \-][0-9]{3})?|3[47][0-9]{13}|3[47][0-9]{2}[ \-][0-9]{6}[ \-][0-9]{5}"
    r"|3(?:0[0-5]|[68][0-9])[0-9]{11}|3(?:0[0-5]|[68][0-9])[0-9][ \-][0-9]{6}[ \-][0-9]{4}|[4-6][0-9]{18}|4[0-9]{12})(?![0-9])",
    "ip": rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])",
    "ipv6": rf"(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f:]*[0-9])(?=[0-9A-Fa-f:]*[0-9A-Fa-f]{{3}})(?:(?:{_GROUP}:){{7}}{_GROUP}|(?:{_GROUP}:){{1,7}}:(?:{_GROUP}(?::{_GROUP}){{0,5}})?"
    rf"|::{_GROUP}(?::{_GROUP}){{1,6}})(?![0-9A-Za-z:])",
    "ssn": r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])",
    # With a country code; after a 0 (pairs, or an area and groups); nine digits by two and three; an area and two groups.
    "phone": rf"(?<![0-9A-Za-z+])(?:\+[0-9]|00[1-9][0-9]{{0,2}}(?=[ \-./(]))(?:{_GAP}[0-9]){{7,14}}(?![0-9]|\.[0-9])"
    rf"|(?<![0-9A-Za-z+.,])(?!{_DATE})(?:0[1-9](?:[ .\-]?[0-9]{{2}}){{4}}|(?:0[1-9][0-9]{{0,3}} ?[ \-/] ?|\(0[1-9][0-9]{{0,3}}\)[ \-/]?)"
    r"(?:[0-9]{2,5}(?:[ \-][0-9]{2,5}){1,3}|[0-9]{5,9})|[6-9][0-9][ .\-][0-9]{3}(?:[ .\-][0-9]{2}){2}|[6-9][0-9]{2}(?:[ .\-][0-9]{2}){3})(?![0-9]|[.,][0-9])"
    r"|(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ \-.]?)?(?:\([0-9]{2,4}\)[ \-.]?|[0-9]{2,4}[ \-.])[0-9]{3,4}[ \-.][0-9]{3,4}(?![0-9])",
    "person": rf"(?<![\p{{L}}])(?=[\p{{Lu}}г])(?:{_TITLE})(?: (?:Dr|Prof)\.?){{0,6}} {_NAMES}|(?=\p{{Lu}})(?<=[eost:] )(?<=(?:{_INTRODUCED}) ){_NAMES}",
}
TITLES = {"f": [
    "Mrs", "Ms", "Miss", "Frau", "Madame", "Mademoiselle", "Mme", "Mlle", "Señora", "Señorita", "Srta", "Sra", "Dra", "Profa", "Doña", "г-жа"]}
NAMES = {
    ("latin", "f"): ["Anna", "Clara", "Elena", "Julia", "Laura", "Maria", "Nora", "Paula", "Sofia", "Vera"],
    ("latin", "m"): ["Adam", "David", "Felix", "Jonas", "Lucas", "Martin", "Oscar", "Paul", "Simon", "Victor"],
    ("cyrillic", "f"): ["Анна", "Вера", "Елена", "Ирина", "Мария", "Нина", "Ольга", "Софья"],
    ("cyrillic", "m"): ["Антон", "Борис", "Виктор", "Денис", "Игорь", "Олег", "Павел", "Юрий"],
}
#: Attempts that keep the length. Later ones add a character each, so that short names and numbers never run out.
SAME_LENGTH = 4
_ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: A text in which this is not found holds no entity, so that it need not be searched.
_HINT = (
    rf"[0-9@]|(?<![A-Za-z0-9])(?=[Aeghrsx])(?:{_START[1:]})|(?<![\p{{L}}])(?=[\p{{Lu}}г])(?:{_TITLE}) |(?=[IJMNijmn])(?:{_INTRODUCED})"
    r"|-----BEGIN |[a-f]{32}|[A-F]{32}")


def with_surrogates(docs: DataFrame, *, key: str, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """``docs`` with every entity in the text replaced.

    Entities are e-mail addresses, access keys of known forms, tokens (JWT), private key blocks and hexadecimal secrets, IBANs, card numbers
    of 13 to 19 digits, IPv4 and IPv6 addresses, social security and telephone numbers, and persons after a title or words
    that introduce a name. Telephone numbers without a country code, a leading 0 or separators, and other names, are not
    told from other numbers and words. A surrogate depends only on ``key`` and the entity, so equal
    entities get equal surrogates in all documents. It keeps length, script, case and separators; an octet stays an
    octet, a hexadecimal secret hexadecimal, a card number passes the same check digit test as before, and a person's first name is
    drawn from names of the same gender (by title) and script; the name is drawn without regard to the title. Mail surrogates end in a reserved domain.

    Distinctness is checked: of entities that share a surrogate, or whose surrogate is itself an entity of the corpus, all
    but the first get another attempt, until none is left. From the ``SAME_LENGTH``-th attempt on surrogates of names, numbers and mail
    get longer (of IPv4 addresses: IPv6), so that this ends also where all of one length are taken. Entities with an attempt above 0 are the only ones joined to
    the texts; all others are replaced where they stand.

    Rows keep their order of columns and are judged on their own; repeated rows are treated alike. A null text stays null.
    ``count_col``, if given, is added (or replaced) and holds the number of entities. ``key`` must be kept secret.
    """
    retried = _retried(docs, key, text_col)
    kept = [c for c in docs.columns if c != count_col]
    found = docs.select(
        *[F.col(c).alias(f"k{i}") for i, c in enumerate(kept)], F.col(text_col).alias("text")).withColumn("found", _entities(F.col("text")))
    if retried.limit(1).count():
        # Few entities had to be tried again. They reach their documents by a join on the entity.
        hit = (
            found.select(F.xxhash64("text").alias("text_hash"), F.explode(F.array_distinct("found")).alias("entity")).distinct()
            .join(retried, "entity").groupBy("text_hash")
            .agg(F.map_from_entries(F.collect_list(F.struct("entity", "attempt"))).alias("attempts")))
        found = found.withColumn("text_hash", F.xxhash64("text")).join(hit, "text_hash", "left")
        attempt = lambda e: F.coalesce(F.element_at("attempts", e), F.lit(0))
    else:
        attempt = lambda e: F.lit(0)
    between = F.when(F.size("found") > 0, F.split("text", _ANY)).otherwise(F.array("text"))
    found = found.withColumn("between", between).withColumn(
        "new", F.transform("found", lambda e: surrogate(e, F.lit(key), attempt(e))))
    text = F.when(F.size("found") == 0, F.col("text")).otherwise(F.array_join(F.flatten(F.zip_with(
        "between", "new", lambda gap, new: F.array(gap, F.coalesce(new, F.lit(""))))), ""))
    columns = [(text if c == text_col else F.col(f"k{i}")).alias(c) for i, c in enumerate(kept)]
    extra = [F.when(F.col("text").isNull(), 0).otherwise(F.size("found")).cast("bigint").alias(count_col)] if count_col else []
    return found.select(*columns, *extra)


def _entities(text: Column) -> Column:
    return F.when(text.rlike(_HINT), F.regexp_extract_all(text, F.lit(f"({_ANY})"), F.lit(0))).otherwise(F.array().cast("array<string>"))


def _retried(docs: DataFrame, key: str, text_col: str) -> DataFrame:
    """(entity, attempt) of the entities whose first surrogate was taken."""
    entities = written_once(
        docs.select(F.explode(_entities(F.col(text_col))).alias("entity")).distinct()
        .withColumn("first", surrogate(F.col("entity"), F.lit(key), F.lit(0))), "entities")
    known = entities.select(F.col("entity").alias("taken"))
    tried = entities.select("entity", F.lit(0).alias("attempt"), F.col("first").alias("new"))
    # All in doubt go on together; the others keep what they have.
    while True:
        clash = (
            tried.groupBy("new").agg(F.count("*").alias("n"), F.min(F.struct("attempt", "entity")).alias("stays"))
            .join(known.withColumn("is_entity", F.lit(True)), F.col("new") == F.col("taken"), "left")
            .where("n > 1 OR is_entity").select("new", F.when(F.col("is_entity").isNull(), F.col("stays.entity")).alias("stays")))
        clash = checkpointed(clash)
        if not clash.limit(1).count():
            return tried.where("attempt > 0").select("entity", "attempt")
        again = tried.join(clash, "new", "left_semi").join(clash, "new")
        moved = again.where("NOT (entity <=> stays)").select("entity", (F.col("attempt") + 1).alias("attempt"))
        stayed = tried.join(moved.select("entity"), "entity", "left_anti")
        tried = checkpointed(stayed.select("entity", "attempt", "new").unionByName(
            moved.withColumn("new", surrogate(F.col("entity"), F.lit(key), F.col("attempt")))))


def surrogate(entity: Column, key: Column, attempt: Column) -> Column:
    """The keyed replacement of an entity. Attempts give different ones."""
    # Persons are drawn by their name, so that the title does not matter. The seed is made once, not for every character.
    # Mail is drawn without regard to case, which it keeps.
    of = F.when(F.instr(entity, "@") > 0, F.lower(entity)).otherwise(F.regexp_replace(entity, _TITLES, ""))
    seed = F.sha2(F.concat_ws("\n", key, attempt.cast("string"), of), 256)
    more = F.greatest(attempt - SAME_LENGTH + 1, F.lit(0)).cast("int")
    bound = F.array(F.struct(entity.alias("entity"), seed.alias("seed"), more.alias("more")))
    return F.transform(bound, lambda x: _drawn(x["entity"], x["seed"], x["more"]))[0]


def _drawn(entity: Column, seed: Column, more: Column) -> Column:
    title = F.regexp_extract(entity, _TITLES, 0)
    name = F.substring(entity, F.length(title) + 1, F.length(entity))
    draw = lambda label, n: F.pmod(F.conv(F.substring(F.sha2(F.concat_ws("\n", seed, label), 256), 1, 12), 16, 10).cast("bigint"), F.lit(n))
    at = lambda i: F.concat(F.lit("c"), i.cast("string"))
    pick = lambda alphabet, i: F.substring(F.lit(alphabet), (draw(at(i), len(alphabet)) + 1).cast("int"), F.lit(1))
    lower, upper = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    small, large = "абвгдежзиклмнопрстуфхцчшщэюя", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЩЭЮЯ"

    def spelled(text: Column, keep_first: bool = False) -> Column:
        def one(c: Column, i: Column) -> Column:
            out = (
                F.when(c.rlike("[0-9]"), pick("0123456789", i)).when(c.rlike("[a-z]"), pick(lower, i)).when(c.rlike("[A-Z]"), pick(upper, i))
                .when(c.rlike(r"\p{IsCyrillic}") & (F.lower(c) == c), pick(small, i)).when(c.rlike(r"\p{IsCyrillic}"), pick(large, i))
                .when(c.rlike(r"\p{Lu}"), pick(upper, i)).when(c.rlike(r"\p{L}"), pick(lower, i)).otherwise(c))
            return F.when(i < 2, c).otherwise(out) if keep_first else out

        return F.array_join(F.transform(F.split(text, ""), one), "")

    hex_ = F.array_join(F.transform(F.split(entity, ""), lambda c, i: F.when(c == ":", c).when(
        entity.rlike("[A-F]"), pick("0123456789ABCDEF", i)).otherwise(pick("0123456789abcdef", i))), "")
    start = F.regexp_extract(entity, _START, 0)
    token = F.concat(start, spelled(F.substring(entity, F.length(start) + 1, F.length(entity))))
    head, foot = (F.regexp_extract(entity, p, 0) for p in ("^-----BEGIN [A-Z0-9 ]+-----", "-----END [A-Z0-9 ]+-----$"))
    block = F.concat(head, spelled(F.substring(entity, F.length(head) + 1, F.length(entity) - F.length(head) - F.length(foot))), foot)
    domain = F.substring_index(entity, "@", -1)
    mail = F.concat(
        spelled(F.concat(F.substring_index(entity, "@", 1), F.repeat(F.lit("a"), more))), F.lit("@"), spelled(F.substring_index(domain, ".", 1)),
        F.lit(".example."), F.element_at(F.array(*map(F.lit, ("com", "net", "org"))), (draw(F.lit("tld"), 3) + 1).cast("int")))
    octets = F.array_join(F.array(
        *[(draw(F.lit(f"o{i}"), n) + low).cast("string") for i, (low, n) in enumerate([(1, 223), (0, 256), (0, 256), (1, 254)])]), ".")
    # No address of version 4 is longer than another, so the long ones are of version 6, from the documentation's range.
    long_ip = F.concat(F.lit("2001:db8"), F.array_join(F.transform(
        F.sequence(F.lit(1), F.lit(6)), lambda i: F.concat(F.lit(":"), F.lower(F.hex(draw(F.concat(F.lit("g"), i.cast("string")), 65536))))), ""))
    octets = F.when(more > 0, long_ip).otherwise(octets)
    number = spelled(F.concat(entity, F.repeat(F.lit("0"), more)))
    # Cards of other than 16 digits keep the two that tell their kind.
    plain = F.length(F.regexp_replace(entity, "[^0-9]", ""))
    number_of_card = F.when(plain == 16, spelled(entity)).otherwise(spelled(entity, keep_first=True))
    whole = F.regexp_replace(number_of_card, "[^0-9]", "")
    last = F.pmod(F.lit(10) - F.pmod(_luhn(F.concat(F.substring(whole, F.lit(1), plain - 1), F.lit("0"))), F.lit(10)), F.lit(10)).cast("string")
    passing = F.pmod(_luhn(F.regexp_replace(entity, "[^0-9]", "")), F.lit(10)) == 0
    card = F.when(passing, F.concat(F.substring(number_of_card, F.lit(1), F.length(entity) - 1), last)).otherwise(number_of_card)
    # An account number keeps its country, and valid check digits if its own are valid.
    account = spelled(entity, keep_first=True)
    rest, own = F.substring(account, F.lit(5), F.length(entity)), F.substring(entity, 1, 4)
    check = F.lpad((F.lit(98) - _mod97(F.concat(rest, F.substring(entity, 1, 2), F.lit("00")))).cast("string"), 2, "0")
    valid = _mod97(F.concat(F.substring(entity, F.lit(5), F.length(entity)), own)) == 1
    iban = F.when(valid, F.concat(F.substring(entity, 1, 2), check, rest)).otherwise(account)
    # A phone number keeps its country code, or the 0 before it.
    country = F.regexp_extract(entity, r"^(?:(?:\+|00)[0-9]{1,3}(?=[ \-./(])|\(?0)", 0)
    phone = F.concat(country, spelled(F.concat(F.substring(entity, F.length(country) + 1, F.length(entity)), F.repeat(F.lit("0"), more))))
    female = F.regexp_extract(title, r"^[^. ]+", 0).isin(TITLES["f"])
    cyrillic = name.rlike(r"\p{IsCyrillic}")
    drawn = lambda script, sex: F.element_at(F.array(*map(F.lit, NAMES[script, sex])), (draw(F.lit("name"), len(NAMES[script, sex])) + 1).cast("int"))
    first = F.when(cyrillic & female, drawn("cyrillic", "f")).when(cyrillic, drawn("cyrillic", "m")).when(female, drawn("latin", "f")).otherwise(drawn("latin", "m"))
    # Names between the first and the last are spelled anew as well.
    longer = F.repeat(F.when(cyrillic, "а").otherwise("a"), more)
    person = F.when(F.instr(name, " ") > 0, F.concat(title, first, F.lit(" "), spelled(F.concat(
        F.substring(name, F.instr(name, " ") + 1, F.length(name)), longer)))).otherwise(F.concat(title, spelled(F.concat(name, longer))))
    whole_is = lambda kind: entity.rlike(f"^(?:{PATTERNS[kind]})$")
    return (
        F.when(entity.rlike("^-----BEGIN "), block).when(F.instr(entity, "@") > 0, mail).when(entity.rlike(f"^(?:{_HEX})$") | whole_is("ipv6"), hex_)
        .when(whole_is("secret"), token)
        .when(whole_is("iban"), iban).when(whole_is("card"), card).when(whole_is("ip"), octets)
        .when(whole_is("ssn"), number).when(whole_is("phone"), phone).otherwise(person))


def _luhn(digits: Column) -> Column:
    """The check sum of a number of up to 20 digits."""
    return F.aggregate(
        F.transform(F.split(F.lpad(digits, 20, "0"), ""), lambda c, i: F.when(F.pmod(i, F.lit(2)) == 0, 2 * c.cast("int") - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int"))),
        F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0)))


def _mod97(account: Column) -> Column:
    """The remainder by 97 of an account number, read as digits with A as 10 to Z as 35; blanks do not count."""
    step = lambda r, c: (
        F.when(c.rlike("[0-9]"), F.pmod(r * 10 + c.try_cast("int"), F.lit(97))).when(c.rlike("[A-Z]"), F.pmod(r * 100 + F.ascii(c) - 55, F.lit(97))).otherwise(r))
    return F.aggregate(F.split(account, ""), F.lit(0), step)
