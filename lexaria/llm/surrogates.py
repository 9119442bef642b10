"""PII surrogates (operator 4, native).

Detected: e-mail addresses, IP addresses, payment cards, IBANs, social security and phone
numbers, long secrets (keys and tokens), and person names after a form of address.  Every entity gets a
surrogate drawn from a keyed SHA-512 of its type and canonical form:

* names: the whole run of name words after a form of address is replaced, word by word: hyphens
  and particles (``van der``) stay between them; the words after the last space are the family
  name, all others given names; initials go through a keyed cycle of the alphabet, so that different
  initials stay different (an initial does not follow the surrogate of the name it may abbreviate);
* coreference: spellings with one canonical form (case, spaces, hyphens) share a surrogate, in
  every document; given and family names are entities of their own, so ``Mr. John Smith``,
  ``Mr. Smith`` and ``Dr. Smith`` stay one person's name; a given name after a neutral title
  takes the surrogate of its gendered mentions, of the more frequent gender if it has two;
* format: digits become digits, letters letters, capitals capitals, punctuation stays; top
  level domains, IBAN countries, the first phone and card digit and hex alphabets are kept,
  cards stay Luhn-valid, IP octets stay in range;
* gender and script: given names are drawn from lists of the gender of the form of address and the
  script of the name; a Cyrillic family name takes its feminine ending from title or word;
* distinctness: surrogates of different entities of a type never coincide, nor equal a real
  entity of the corpus; a collision check over the table of distinct entities redraws the
  later ones (from the eighth draw on with extra characters) until none is left.

Scale: only distinct entities are drawn and checked; texts without entities are never
shuffled; a hot entity is spread over salts.  Everything is DataFrame expressions.

Not detected: names without a form of address or in scripts without capitals, dates of birth,
street addresses, document numbers.

Cases: runs of any number of name words are replaced as a whole; null text stays null with no entities; texts without entities stay as they are;
repeated rows get the same text; a null id is a value like any other; an empty table gives an empty
result; other columns pass through, and the result columns replace columns of
their names.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexaria.llm.common import keep, left_join_salted

# Forms of address and their gender.
ADDRESS = {
    "m": ["Mr", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Don", "г-н", "господин", "Κύριος"],
    "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Señorita", "Sra", "Srta", "Doña", "г-жа", "госпожа", "Κυρία"],
    "n": ["Dr", "Prof"],
}
# Name lists by script and gender (n: of either).
GIVEN = {
    "latin": {
        "m": "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karl Louis Marco Noah Oscar Paul Robert Simon Thomas Victor".split(),
        "f": "Anna Berta Clara Diana Elena Flora Greta Helena Irene Julia Karla Laura Maria Nora Olga Paula Rosa Sofia Teresa Vera".split(),
    },
    "cyrillic": {"m": "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Леонид Максим".split(),
                 "f": "Анна Белла Вера Галина Дарья Елена Инна Ксения Лидия Мария".split()},
    "greek": {"m": "Αλέξης Βασίλης Γιώργος Δημήτρης Ηλίας Κώστας Νίκος Πέτρος".split(),
              "f": "Άννα Βασιλική Γεωργία Δήμητρα Ελένη Κατερίνα Μαρία Σοφία".split()},
}
FAMILY = {
    "latin": "Adler Berger Castro Duval Ferrer Garner Huber Jansen Keller Lambert Moreau Navarro Olsen Petit Quinn Ramos Sommer Turner Vidal Weber".split(),
    "cyrillic": "Абрамов Белов Волков Громов Ершов Жуков Зайцев Козлов Лебедев Морозов".split(),
    "greek": "Αγγέλου Βλάχου Γεωργίου Δήμου Ιωάννου Καρρά Νικολάου Παππά".split(),
}
SYLLABLES = {"latin": "ba be bo da de do ka ke ko la le lo ma me mo na ne no ra re".split(),
             "cyrillic": "ба бе бо да де до ка ке ко ла ле ло ма ме мо на".split(),
             "greek": "βα βε βο δα δε δο κα κε κο λα λε λο μα με μο να".split()}

# The letters of initials.
ALPHABET = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзийклмнопрстуфхцчшщэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}

_FEMININE = "([оеё]в|[иы]н)а$"
_TITLES = "|".join(sorted((t for ts in ADDRESS.values() for t in ts), key=len, reverse=True))
_LETTER = r"[\p{L}\p{M}]"
_END = r"(?![\p{L}\p{N}\p{M}])"
# repeats of groups are possessive (*+): the engine then loops instead of recursing, however long a run is
_CHAIN = rf"(?:{_TITLES})\.?[ ](?:(?:Dr|Prof)\.?[ ])*+"
# an initial, or a capital and letters with inner capitals and apostrophes (not 's, 'll, ...)
_PIECE = (rf"(?:\p{{Lu}}\p{{M}}*\.|(?:\p{{Ll}}{{1,2}}['’])?\p{{Lu}}{_LETTER}*(?:['’](?:\p{{Lu}}{_LETTER}+|\p{{Ll}}{{3,}}){_END})*+)")
_WORD = rf"{_PIECE}(?:(?:(?<=\.)|[-‐‑]){_PIECE}(?:(?<=\.)|{_END}))*+"
_PARTICLES = r"(?:(?:van|von|der|den|de|del|della|di|da|dos|das|du|la|le|los|las|ter|ten|zu|zum|zur|af|av|bin|bint|ibn|al|el|y)[ -])*+"
# a next title, a suffix, or a lone capital before no further name word ends the run
_STOP = (rf"(?!(?:{_TITLES})\.?[ ]\p{{Lu}}|(?:Jr|Sr|II|III|IV|Esq|PhD|MD){_END}"
         rf"|\p{{Lu}}(?![\p{{L}}\p{{M}}.'’‐‑-])(?![ ]\p{{Lu}}{_LETTER}))")
NAME = rf"(?<![\p{{L}}\p{{N}}]){_CHAIN}{_PARTICLES}{_WORD}{_END}(?:[ ]{_PARTICLES}{_STOP}{_WORD}{_END})*+"
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}][\p{L}\p{N}._%+-]{0,63}@(?:[\p{L}\p{N}](?:[\p{L}\p{N}-]{0,62})\.){1,126}\p{L}{2,24}"
SECRET = r"(?<![\p{L}\p{N}])(?:(?=[A-Za-z]*[0-9])(?=[0-9]*[A-Za-z])[0-9A-Za-z]{32,}|AKIA[0-9A-Z]{16})(?![\p{L}\p{N}])"
IBAN = r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?:[ ]?[0-9A-Z]{4}){3,7}(?:[ ]?[0-9A-Z]{1,3})?(?![\p{L}\p{N}])"
IP = r"(?<![\p{N}.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?!\.?\p{N})"
SSN = r"(?<![\p{L}\p{N}-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}-])"
PHONE = (r"(?<![\p{L}\p{N}+])(?:\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}"
         r"|\([0-9]{3}\)[ ]?[0-9]{3}[-. ][0-9]{4}|[0-9]{3}[-.][0-9]{3}[-.][0-9]{4})(?![\p{L}\p{N}])")
CARD = r"(?<![\p{L}\p{N}])[0-9](?:[ -]?[0-9]){12,18}(?![\p{L}\p{N}])"
KINDS = {"email": EMAIL, "secret": SECRET, "iban": IBAN, "ip": IP, "ssn": SSN, "phone": PHONE, "card": CARD, "name": NAME}
PATTERN = "|".join(f"(?:{p})" for p in KINDS.values())
# what every entity holds; texts without it are not searched further
QUICK = rf"[0-9@]|(?:{_TITLES})\.? "


def _kind(m: Column) -> Column:
    out = None
    for k, p in KINDS.items():
        out = F.when(m.rlike(f"^(?:{p})$"), k) if out is None else out.when(m.rlike(f"^(?:{p})$"), k)
    return out.otherwise("name")


def _script(c: Column) -> Column:
    return F.when(c.rlike(r"\p{IsCyrillic}"), "cyrillic").when(c.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _name(m: Column) -> Column:
    """A mention of a name without its forms of address."""
    return F.regexp_replace(m, f"^{_CHAIN}", "")


def _words(m: Column) -> Column:
    """The name words of a mention, those joined by hyphens one by one."""
    return F.regexp_extract_all(_name(m), F.lit(_PIECE), F.lit(0))


def _gender(m: Column) -> Column:
    title = lambda g: rf"^(?:{'|'.join(ADDRESS[g])})\.?[ ]"
    return F.when(m.rlike(title("m")), "m").when(m.rlike(title("f")), "f").otherwise("n")


def keys(kind: Column, mention: Column) -> Column:
    """Entities of a mention: array of (type, canonical form, ending).  Types of given names carry gender, of all names script."""
    plain = F.when(kind.isin("card", "iban", "ssn", "phone"), F.lower(F.regexp_replace(mention, r"[^\p{L}\p{N}+]", ""))) \
        .otherwise(F.lower(mention))
    words = _words(mention)
    n_last = F.size(F.regexp_extract_all(F.regexp_extract(mention, "[^ ]+$", 0), F.lit(_PIECE), F.lit(0)))

    def entity(w, i, of):
        n, initial = F.size(of["words"]), F.length(F.rtrim(w, F.lit("."))) == 1
        family = (i == n - 1) | ((i >= n - of["last"]) & ~w.endswith("."))
        canon = F.translate(F.rtrim(F.lower(w), F.lit(".")), "’", "'")
        slavic = family & ~initial & (_script(w) == "cyrillic")
        female = slavic & ((of["gender"] == "f") | canon.rlike(_FEMININE))
        part = F.when(initial, "initial/n/").when(family, "family/n/").otherwise(F.concat(F.lit("given/"), of["gender"], F.lit("/")))
        return F.struct(
            F.concat(part, _script(w)).alias("type"),
            F.when(slavic, F.regexp_replace(canon, _FEMININE, "$1")).otherwise(canon).alias("canon"),
            F.when(female, "а").otherwise("").alias("ending"))

    other = F.array(F.struct(kind.alias("type"), plain.alias("canon"), F.lit("").alias("ending")))
    # the mention's own properties are bound once, not per word
    bound = F.array(F.struct(words.alias("words"), n_last.alias("last"), _gender(mention).alias("gender")))
    named = F.flatten(F.transform(bound, lambda of: F.transform(of["words"], lambda w, i: entity(w, i, of))))
    return F.when(kind == "name", named).otherwise(other)


def letters(secret: str) -> dict[str, dict[str, str]]:
    """By script, the letter that stands for an initial: one keyed cycle through the alphabet, so no letter
    stays and no two fall together."""
    out = {}
    for script, alphabet in ALPHABET.items():
        ring = sorted(alphabet, key=lambda c: hashlib.sha512(f"{secret}|{script}|{c}".encode()).digest())
        out[script] = dict(zip(ring, ring[1:] + ring[:1]))
    return out


def _by_type(lists: dict[str, str]) -> str:
    """The word list of a type; every list is one literal in the plan."""
    whens = " ".join(f"when type like '{t}' then split('{words}', ' ')" for t, words in lists.items())
    return f"case {whens} end"


def _draw(secret: str) -> tuple[Column, Column]:
    """(surrogate of (type, canon, attempt), the hex digits it reads from ``stream``): letters and digits in
    order, or the whole value for names and IPs."""
    raw, secret = secret, secret.replace("\\", "\\\\").replace("'", "\\'")
    seed = f"concat_ws('|', '{secret}', type, canon, cast(attempt as string))"
    # a stream of hex digits as long as the value needs
    stream = f"array_join(transform(sequence(0, length(canon) div 60), j -> sha2(concat({seed}, '|', cast(j as string)), 512)), '')"
    byte = lambda at: f"cast(conv(substr(stream, {at} * 2 + 1, 2), 16, 10) as int)"
    number = lambda at: f"cast(conv(substr(stream, {at} * 8 + 1, 8), 16, 10) as bigint)"
    of, cycle, initials = {}, letters(raw), []
    for script in GIVEN:
        both = [v for pair in zip(GIVEN[script]["m"], GIVEN[script]["f"]) for v in pair]
        for g in "mfn":
            of[f"given/{g}/{script}"] = " ".join(GIVEN[script].get(g, both))
        of[f"family/_/{script}"] = " ".join(FAMILY[script])
        table = cycle[script]
        other = f"substr('{ALPHABET[script]}', cast({number(0)} % {len(table)} + 1 as int), 1)"
        first = f"translate(canon, '{''.join(table)}', '{''.join(table.values())}')"
        initials.append(f"when type like 'initial/_/{script}' then upper(if(instr('{ALPHABET[script]}', canon) > 0, {first}, {other}))")
    pick = lambda values, at: f"element_at({values}, cast({number(at)} % size({values}) + 1 as int))"
    tail = _by_type({f"%/{script}": " ".join(SYLLABLES[script]) for script in SYLLABLES})
    more = f"array_join(transform(if(attempt = 0, array(), sequence(1, attempt)), j -> {pick('part.tail', '(j + 2)')}), '')"
    named = pick("part.head", "if(type like 'family/%', 1, 0)")
    # the lists are chosen once, for a bound variable
    whole = (f"element_at(transform(array(named_struct('head', {_by_type(of)}, 'tail', {tail})), part -> concat({named}, {more})), 1)")
    lists = [f"when type like 'given/%' or type like 'family/%' then {whole}", *initials]
    ip = (f"when type = 'ip' then concat_ws('.', {byte(0)} % 223 + 1, {byte(1)}, {byte(2)}, {byte(3)} % 254 + 1, "
          "if(attempt < 8, null, cast(attempt as string)))")
    body = f"""array_join(transform(sequence(1, length(alnum)), k -> case
        when type = 'email' and k > length(alnum) - tld then substr(alnum, k, 1)
        when type in ('phone', 'card') and k = 1 then substr(alnum, k, 1)
        when type = 'iban' and k <= 2 then substr(alnum, k, 1)
        when substr(alnum, k, 1) rlike '[0-9]' then cast({byte('k')} % 10 as string)
        when type = 'secret' and canon rlike '^[0-9a-f]+$' then substr('abcdef', {byte('k')} % 6 + 1, 1)
        else substr('abcdefghijklmnopqrstuvwxyz', {byte('k')} % 26 + 1, 1) end), '')"""
    more = f"if(attempt < 8, '', substr(stream, 1, attempt - 7))"
    return F.expr(f"case {' '.join(lists)} {ip} else concat({body}, {more}) end").alias("drawn"), F.expr(stream).alias("stream")


def _luhn_sum(digits: str) -> str:
    """Luhn sum of a digit string, the last digit being the check digit."""
    n = f"length({digits})"
    one = f"cast(substr({digits}, i, 1) as int)"
    return (f"aggregate(sequence(1, {n}), 0, (a, i) -> a + if(({n} - i) % 2 = 0, {one}, "
            f"if({one} > 4, 2 * {one} - 9, 2 * {one})))")


def registry(entities: DataFrame, secret: str) -> DataFrame:
    """(type, canon, surrogate) for distinct (type, canon); surrogates of a type are distinct and no real entity."""
    table = entities.select("type", "canon").distinct().withColumn("attempt", F.lit(0))
    table = table.withColumn("alnum", F.regexp_replace("canon", r"[^\p{L}\p{N}]", ""))
    table = keep(table.withColumn("tld", F.length(F.regexp_extract("canon", r"\.(\p{L}+)$", 1))))
    family = F.regexp_extract("type", "^[^/]+", 0).alias("family")
    real = keep(table.select(family, F.when(F.col("type").rlike("/|ip"), F.col("canon")).otherwise(F.col("alnum")).alias("value"))
                .distinct().withColumn("real", F.lit(True)))
    drawn, stream = _draw(secret)
    check = f"(10 - {_luhn_sum('concat(substr(drawn, 1, length(drawn) - 1), 0)')} % 10) % 10"
    while True:
        now = table.select("*", stream).select("type", "canon", "alnum", "tld", "attempt", drawn)
        # stored: every surrogate is drawn once, and the check below plans over plain columns
        now = keep(now.select("type", "canon", "alnum", "tld", "attempt", F.expr(
            f"if(type = 'card' and attempt < 8 and {_luhn_sum('alnum')} % 10 = 0, "
            f"concat(substr(drawn, 1, length(drawn) - 1), cast({check} as string)), drawn)").alias("surrogate")))
        now = now.select("*", family, F.lower("surrogate").alias("value"))
        first = now.groupBy("family", "value").agg(F.min(F.struct("attempt", "type", "canon")).alias("first"))
        now = now.join(first, ["family", "value"]).join(real, ["family", "value"], "left")
        clash = F.col("real").isNotNull() | (F.col("first.type") != F.col("type")) | (F.col("first.canon") != F.col("canon"))
        clash = clash & ~F.col("type").startswith("initial/")  # one cycle of letters: distinct as they are
        now = keep(now.select("type", "canon", "alnum", "tld", "attempt", "surrogate", clash.alias("clash")))
        if not now.where("clash").limit(1).count():
            return now.select("type", "canon", "surrogate")
        table = now.withColumn("attempt", F.col("attempt") + F.col("clash").cast("int")).drop("surrogate", "clash")


def dressed(mention: Column, kind: Column, surrogates: Column) -> Column:
    """The surrogate in the mention's own format."""
    m, s = mention, F.element_at(surrogates, 1)
    chars = F.split(m, "(?!^)(?!$)")
    seen = lambda i: F.length(F.regexp_replace(F.substring(m, F.lit(1), i + 1), r"[^\p{L}\p{N}]", ""))
    same = lambda c, x: F.when(c.rlike(r"\p{Lu}"), F.upper(x)).otherwise(x)
    filled = F.transform(chars, lambda c, i: F.when(c.rlike(r"[\p{L}\p{N}]"), same(c, F.substring(s, seen(i), F.lit(1)))).otherwise(c))
    size = F.length(F.regexp_replace(m, r"[^\p{L}\p{N}]", ""))
    rest = F.substring(s, size + 1, F.lit(99))
    title, words = F.regexp_extract(m, f"^{_CHAIN}", 0), _words(m)
    fit = lambda x, w: F.when(w.endswith("."), F.concat(F.substring(x, 1, 1), F.lit("."))) \
        .when(w.rlike(r"^[\p{Lu}\p{M}'’]{2,}$"), F.upper(x)).otherwise(x)
    gaps, fresh = F.split(_name(m), _PIECE, -1), F.zip_with(surrogates, words, fit)
    name = F.concat(title, F.array_join(F.zip_with(gaps, F.concat(fresh, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), ""))
    return F.when(kind == "name", name).when(kind == "ip", s).otherwise(F.concat(F.array_join(filled, ""), rest))


def named_entities(said: DataFrame, secret: str) -> DataFrame:
    """(entity, surrogate) of all (type, canon) said; a given name of neutral gender goes by its gendered mentions."""
    told = keep(said.groupBy("type", "canon").agg(F.count("*").alias("n")))
    script = F.regexp_extract("type", "[^/]+$", 0)
    gendered = told.where(F.col("type").rlike("^given/[mf]/")).groupBy(script.alias("script"), "canon").agg(
        F.max(F.struct("n", "type")).getField("type").alias("other"))
    neutral = F.col("type").startswith("given/n/")
    goes = keep(told.where(neutral).withColumn("script", script).join(gendered, ["script", "canon"]).select("type", "canon", "other"))
    known = registry(told.join(goes, ["type", "canon"], "left_anti"), secret)
    more = goes.join(known.withColumnRenamed("type", "other"), ["other", "canon"]).select("type", "canon", "surrogate")
    return known.unionByName(more).select(F.struct("type", "canon").alias("entity"), "surrogate")


def replace_entities(docs: DataFrame, secret: str, id_col: str = "doc_id", text_col: str = "text",
                     out_types: str = "entity_types") -> DataFrame:
    """``docs`` with surrogates in the text and the types of the entities in text order in ``out_types``."""
    names = [c for c in docs.columns if c != out_types]
    src = docs.select(F.struct(*names).alias("_doc"), F.col(text_col).alias("_text"),
                      F.coalesce(F.col(id_col).cast("string"), F.lit("-")).alias("_id"))
    found = F.when(F.col("_text").rlike(QUICK), F.regexp_extract_all("_text", F.lit(PATTERN), F.lit(0)))
    src = src.withColumn("_found", F.coalesce(found, F.array().cast("array<string>")))
    hit = src.where(F.size("_found") > 0).withColumn("_h", F.xxhash64("_text"))

    said = hit.select("_id", "_h", F.posexplode("_found").alias("pos", "mention")).distinct()
    said = said.withColumn("kind", _kind(F.col("mention")))
    parts = said.select("*", F.posexplode(keys(F.col("kind"), F.col("mention"))).alias("sub", "e"))
    once = F.when(F.col("sub") == 0, F.col("mention")).alias("mention")  # a mention of many words goes with its first one
    parts = keep(parts.select("_id", "_h", "pos", once, "kind", "sub", "e.type", "e.canon", "e.ending"))
    known = named_entities(parts, secret)
    parts = parts.withColumn("entity", F.struct("type", "canon"))
    parts = left_join_salted(parts, known, "entity", F.struct("_id", "_h", "pos"))
    parts = parts.withColumn("surrogate", F.concat("surrogate", "ending"))
    whole = parts.groupBy("_id", "_h", "pos").agg(
        F.max("mention").alias("mention"), F.max("kind").alias("kind"),
        F.transform(F.array_sort(F.collect_list(F.struct("sub", "surrogate"))), lambda x: x["surrogate"]).alias("s"))
    whole = whole.withColumn("new", dressed(F.col("mention"), F.col("kind"), F.col("s")))
    per = whole.groupBy("_id", "_h").agg(F.array_sort(F.collect_list(F.struct("pos", "kind", "new"))).alias("_list"))

    done = hit.join(per, ["_id", "_h"])
    gaps = F.split("_text", PATTERN, -1)
    fresh = F.transform("_list", lambda x: x["new"])
    text = F.array_join(F.zip_with(gaps, F.concat(fresh, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    done = done.select("_doc", text.alias("_text"), F.transform("_list", lambda x: x["kind"]).alias("_types"))
    rest = src.where(F.size("_found") == 0).select("_doc", "_text", F.array().cast("array<string>").alias("_types"))
    got = rest.unionByName(done)
    return got.select(*[F.col("_text").alias(c) if c == text_col else F.col("_doc")[c].alias(c) for c in names],
                      F.col("_types").alias(out_types))
