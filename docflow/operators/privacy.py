"""Reversible pseudonyms for person records and the free text around them.

Picks are keyed hashes: the same salt gives the same persona on every run and executor, and without
the salt a pseudonym cannot be derived from an identity. Pass a fresh salt for one-off random output.
"""

from __future__ import annotations

import math
import unicodedata
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docflow.functions.text import SPACES, constant, is_empty_marker, let, norm_space, normalize_token, strip_accents
from docflow.functions.wordlists import FEMALE_TOKENS, MALE_TOKENS, NOT_GIVEN
from docflow.runtime import explode_rows, grows


@dataclass(frozen=True)
class Pools:
    """Values a persona is drawn from. Replace them to suit a region or a size of population."""

    first_m: tuple[str, ...] = (
        "Antoine", "Benoît", "Denis", "Émile", "Fabrice", "Guy", "Hugues", "Ivan", "Joël", "Léon",
        "Marc", "Noël", "Octave", "Rémi", "Serge", "Théo",
    )
    first_f: tuple[str, ...] = (
        "Agnès", "Béatrice", "Cécile", "Denise", "Élise", "Florence", "Gisèle", "Irène", "Josiane",
        "Léa", "Maud", "Noémie", "Odile", "Renée", "Simone", "Thérèse",
    )
    last: tuple[str, ...] = (
        "Arnaud", "Besson", "Carlier", "Delmas", "Ferrand", "Guérin", "Huet", "Jacob", "Lambert",
        "Marchal", "Noiret", "Pichon", "Rivière", "Salmon", "Tessier", "Vasseur",
    )
    streets: tuple[str, ...] = (
        "rue des Tilleuls", "avenue du Parc", "chemin des Vignes", "place du Marché", "rue de la Fontaine",
        "boulevard des Alpes", "allée des Cerisiers", "quai de la Loire",
    )
    towns: tuple[tuple[str, str], ...] = (
        ("14000", "Caen"), ("29200", "Brest"), ("38000", "Grenoble"), ("54000", "Nancy"),
        ("63000", "Clermont-Ferrand"), ("76000", "Rouen"), ("87000", "Limoges"), ("90000", "Belfort"),
    )


CIVIL = "usager.Informations d'état civil"
PERSON = f"{CIVIL}.personnePhysique"

# --- fixed values: replaced fields in replacement order, with the persona field that replaces them ---
USAGER_FIELDS = (
    (f"{CIVIL}.clientId", "client_id"),
    (f"{PERSON}.nomFamille", "last_name"),
    (f"{PERSON}.nomUtilise", "last_name"),
    (f"{PERSON}.prenomsActeNaissance", "first_name"),
    (f"{PERSON}.premierPrenomActeNaissance", "first_name"),
    (f"{PERSON}.prenomUtilise", "first_name"),
    (f"{PERSON}.situationFamiliale", "not_given"),
    (f"{PERSON}.dateNaissance", "dob"),
    ("usager.adresse.ligne[0]", "address_line"),
    ("usager.adresse.codePostal", "postcode"),
    ("usager.adresse.libelleCommune", "commune"),
    ("usager.adresse.commentaire", "commentaire"),
    ("usager.contactInfosPersonnels.domicile", "domicile"),
    ("usager.contactInfosPersonnels.mobile", "mobile"),
    ("usager.contactInfosPersonnels.mail", "mail"),
)
CONTACT_FIELDS = (("civilite", "civilite"), ("prenomUtilise", "first_name"), ("nomUtilise", "last_name"), ("dateNaissance", "dob"))
BLANK_TO_DEFAULT = (
    f"{PERSON}.situationFamiliale", "usager.contactInfosPersonnels.domicile",
    "usager.contactInfosPersonnels.mobile", "usager.contactInfosPersonnels.mail",
)


def detect_gender(sex: Column, title: Column) -> Column:
    """M or F from the sex field, else from the title, else null."""

    def told(x: Column) -> Column:
        t = normalize_token(x)
        return F.when(t.isin(*MALE_TOKENS), "M").when(t.isin(*FEMALE_TOKENS), "F")

    return F.coalesce(told(sex), told(title))


def keyed_number(salt: str, key: Column, field: str) -> Column:
    """Uniform number below 2**32 from the salt, the person's key and the field."""
    digest = F.sha2(F.concat_ws("|", F.lit(salt), key, F.lit(field)), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def _plain(text: str) -> str:
    """``plain_name`` of a constant."""
    folded = unicodedata.normalize("NFKD", text.lower()).lower()
    return " ".join("".join(c for c in folded if unicodedata.category(c) != "Mn").split())


def _pick(options, salt: str, key: Column, field: str, own: Column | None = None) -> Column:
    """One of the options; those whose plain form is among ``own`` are left out before the pick.

    If none is left, a numbered form of the first option is taken, so the real value never comes out.
    """
    number = keyed_number(salt, key, field)
    if own is None:
        return F.get(constant(options), F.pmod(number, F.lit(len(options))).cast("int"))
    plain = constant({o: _plain(o) for o in options})
    # inside the filter's function the array would be made anew for every option
    left = let(own, lambda mine: F.filter(constant(options), lambda o: ~F.array_contains(mine, plain[o])))
    return let(
        left,
        lambda some: F.when(
            F.size(some) > 0, F.get(some, F.pmod(number, F.greatest(F.size(some), F.lit(1))).cast("int"))
        ).otherwise(F.lit(f"{options[0]}#0")),
    )


def age_distribution(mean: float = 83, sd: float = 6.5, low: int = 60, high: int = 100) -> list[tuple[int, float]]:
    """Cumulative probabilities of a truncated normal over whole ages."""
    weights = [math.exp(-0.5 * ((age - mean) / sd) ** 2) for age in range(low, high + 1)]
    total, reached, table = sum(weights), 0.0, []
    for age, weight in zip(range(low, high + 1), weights):
        reached += weight / total
        table.append((age, reached))
    return table[:-1] + [(high, 1.0)]


def sample_dob(salt: str, key: Column, as_of_year: int) -> Column:
    """Birth date whose age follows the distribution: inverse CDF, then month and day."""
    u = keyed_number(salt, key, "age") / F.lit(2.0**32)
    table = age_distribution()
    below = F.size(F.filter(constant([c for _, c in table]), lambda c: c < u))
    age = F.get(constant([a for a, _ in table]), below)
    month = F.pmod(keyed_number(salt, key, "month"), F.lit(12)) + 1
    day = F.pmod(keyed_number(salt, key, "day"), F.lit(28)) + 1
    return F.date_format(F.make_date(F.lit(as_of_year) - age, month.cast("int"), day.cast("int")), "yyyy-MM-dd")


def with_persona(people: DataFrame, key: Column, gender: Column, salt: str, as_of_year: int, pools: Pools = Pools(),
                 own: Column | None = None) -> DataFrame:
    """Add the persona columns: names, address, client id, contact placeholders, title, birth date.

    ``own`` is an array of the person's real values in plain form; no alias is taken from it.
    """
    if not salt:
        raise ValueError("a secret salt is required: unsalted pseudonyms can be recomputed by anyone")
    known = F.coalesce(gender, F.lit("?"))
    towns = {f"{code} {name}": (code, name) for code, name in pools.towns}
    if own is None:
        town = _pick(tuple(towns), salt, key, "town")
    else:
        def lives_in(t: str) -> Column:
            code, _, name = t.partition(" ")
            return F.when(F.array_contains(own, code) | F.array_contains(own, name or code), t)

        mine = F.array_compact(F.array(*[lives_in(_plain(t)) for t in towns]))
        town = _pick(tuple(towns), salt, key, "town", mine)
    number = (F.pmod(keyed_number(salt, key, "number"), F.lit(199)) + 1).cast("string")

    streets = None if own is None else F.transform(own, lambda o: F.regexp_replace(o, "^[0-9]+ ?(?:bis |ter )?,? ?", ""))

    def of_town(i: int) -> Column:
        return F.coalesce(constant({k: v[i] for k, v in towns.items()})[town], F.lit(f"{pools.towns[0][i]}#0"))

    first = (
        F.when(known == "M", _pick(pools.first_m, salt, key, "first", own))
        .when(known == "F", _pick(pools.first_f, salt, key, "first", own))
        .otherwise(_pick(pools.first_m + pools.first_f, salt, key, "first", own))
    )
    title = F.when(known == "M", "M.").when(known == "F", "Mme").otherwise(_pick(("M.", "Mme"), salt, key, "title"))
    digest = F.sha2(F.concat_ws("|", F.lit(salt), key, F.lit("client")), 256)
    return people.select(
        "*",
        first.alias("first_name"),
        _pick(pools.last, salt, key, "last", own).alias("last_name"),
        F.concat(number, F.lit(" "), _pick(pools.streets, salt, key, "street", streets)).alias("address_line"),
        of_town(0).alias("postcode"),
        of_town(1).alias("commune"),
        F.lit("Accès : interphone").alias("commentaire"),
        F.concat(F.lit("CLT-"), F.upper(F.substring(digest, 1, 8))).alias("client_id"),
        *[F.lit(f"{n}_1").alias(n) for n in ("domicile", "mobile", "mail")],
        F.lit(NOT_GIVEN).alias("not_given"),
        title.alias("civilite"),
        sample_dob(salt, key, as_of_year).alias("dob"),
    )


def _who() -> Column:
    """Whose field a leaf is: ``usager``, ``contacts[i]`` or null."""
    return F.when(F.col("path").startswith("usager."), "usager").otherwise(
        F.nullif(F.regexp_extract("path", r"^(contacts\[[0-9]+\])\.", 1), F.lit(""))
    )


def personas(leaves: DataFrame, doc_id: str, salt: str, as_of_year: int, pools: Pools = Pools(),
             targets: Column | None = None) -> DataFrame:
    """One persona per person named in a record, keyed by ``doc_id, who``.

    ``targets`` collects a value per leaf of the person (nulls skipped) next to the persona.
    """

    def field(*names: str) -> Column:
        return F.max(F.when(F.col("path").rlike(r"personnePhysique\.(" + "|".join(names) + ")$"), F.col("value")))

    named = F.col("path").rlike(r"personnePhysique\.(nomFamille|nomUtilise|prenomsActeNaissance|premierPrenomActeNaissance|prenomUtilise)$")
    placed = F.col("path").isin("usager.adresse.ligne[0]", "usager.adresse.codePostal", "usager.adresse.libelleCommune")
    # a name of several words counts as a whole and word by word
    whole = plain_name(F.col("value"))
    real = F.when(named, F.concat(F.array(whole), F.split(whole, " "))).when(placed, F.array(whole))
    extra = [] if targets is None else [F.collect_list(targets).alias("targets")]
    people = (
        leaves.withColumn("who", _who())
        .where(F.col("who").isNotNull())
        .groupBy(doc_id, "who")
        .agg(
            field("sexe", "Sexe").alias("sex"), field("civilite", "Civilite").alias("title"),
            F.array_distinct(F.flatten(F.collect_set(real))).alias("own"), *extra,
        )
    )
    key = F.concat_ws("|", F.col(doc_id).cast("string"), "who")
    return with_persona(people, key, detect_gender(F.col("sex"), F.col("title")), salt, as_of_year, pools, F.col("own")).drop("own")


def replacements(leaves: DataFrame, doc_id: str, salt: str, as_of_year: int, pools: Pools = Pools()) -> DataFrame:
    """``doc_id, path, original, alias, seq, mapped`` for every field to be replaced.

    Two originals never share an alias inside a document: the second distinct one gets ``#2``, the
    next ``#3``. Blank phone, mail and family status become a default without a mapping entry. The
    fields of one document are numbered inside its own row; the leaves are read once.
    """
    contact = r"^contacts\[([0-9]+)\]\.personnePhysique\.(civilite|prenomUtilise|nomUtilise|dateNaissance)$"
    usager_seq = constant({path: n for n, (path, _) in enumerate(USAGER_FIELDS)})
    usager_field = constant({path: field for path, field in USAGER_FIELDS})
    contact_seq = constant({name: n for n, (name, _) in enumerate(CONTACT_FIELDS)})
    contact_field = constant({name: field for name, field in CONTACT_FIELDS})
    part = F.nullif(F.regexp_extract("path", contact, 2), F.lit(""))
    number = F.nullif(F.regexp_extract("path", contact, 1), F.lit("")).try_cast("bigint")
    seq = F.coalesce(usager_seq[F.col("path")].cast("bigint"), 1000 + number * 10 + contact_seq[part])
    field = F.coalesce(usager_field[F.col("path")], contact_field[part])
    blank = F.col("path").isin(*BLANK_TO_DEFAULT) & (F.col("value").isNull() | is_empty_marker("value"))
    target = F.struct(seq.alias("seq"), "path", F.col("value").alias("original"), field.alias("field"), blank.alias("blank"))

    people = personas(leaves, doc_id, salt, as_of_year, pools, F.when(field.isNotNull(), target))
    names = dict.fromkeys(f for _, f in (*USAGER_FIELDS, *CONTACT_FIELDS))
    persona = F.create_map(*[x for n in names for x in (F.lit(n), F.col(n))])
    based = F.transform(
        "targets",
        lambda t: F.struct(
            t["seq"].alias("seq"), t["path"].alias("path"), t["original"].alias("original"),
            F.col("persona")[t["field"]].alias("base"), t["blank"].alias("blank"),
        ),
    )
    docs = (
        people.withColumn("persona", persona)
        .select(doc_id, based.alias("t"))
        .groupBy(doc_id)
        .agg(F.array_sort(F.flatten(F.collect_list("t"))).alias("t"))
    )

    def finish(t: Column) -> Column:
        same_base = F.filter(
            F.col("t"), lambda o: (o["base"] == t["base"]) & ~o["blank"] & o["original"].isNotNull()
        )
        order = F.array_distinct(F.transform(same_base, lambda o: o["original"]))
        place = F.array_position(order, t["original"])
        numbered = F.when(place == 1, t["base"]).otherwise(F.concat(t["base"], F.lit("#"), place.cast("string")))
        return F.struct(
            t["path"].alias("path"), t["original"].alias("original"),
            F.when(t["blank"], NOT_GIVEN).otherwise(numbered).alias("alias"), t["seq"].alias("seq"), (~t["blank"]).alias("mapped"),
        )

    used = F.filter(F.col("t"), lambda t: t["blank"] | t["original"].isNotNull())
    return explode_rows(docs, [doc_id], F.transform(used, finish), "n", "r").select(doc_id, "r.*")


def apply_replacements(leaves: DataFrame, changes: DataFrame, doc_id: str) -> DataFrame:
    """Leaves with replaced values."""
    new = changes.select(doc_id, "path", "alias")
    return (
        leaves.join(grows(new), [doc_id, "path"], "left")
        .withColumn("type", F.when(F.col("alias").isNotNull(), "string").otherwise(F.col("type")))
        .withColumn("value", F.coalesce("alias", "value"))
        .drop("alias")
        .select(*leaves.columns)
    )


def missing_defaults(leaves: DataFrame, doc_id: str) -> DataFrame:
    """Default leaves for contact fields and family status that a record does not hold at all."""
    wanted = F.array(*[F.lit(p) for p in BLANK_TO_DEFAULT])
    have = leaves.groupBy(doc_id).agg(
        *[F.coalesce(F.bool_or(F.col("path") == p), F.lit(False)).alias(f"has{n}") for n, p in enumerate(BLANK_TO_DEFAULT)]
    )
    flags = F.array(*[F.col(f"has{n}") for n in range(len(BLANK_TO_DEFAULT))])
    pairs = F.filter(F.arrays_zip(wanted.alias("path"), flags.alias("has")), lambda z: ~z["has"])
    rows = have.select(doc_id, F.inline(pairs)).drop("has")
    return rows.select(
        doc_id, F.split("path", r"\.").alias("keys"), "path", F.lit("string").alias("type"), F.lit(NOT_GIVEN).alias("value")
    )


# ------------------------------------------------------------------ free text

def _letter_classes() -> dict[str, str]:
    """Each plain letter to a character class of all letters that ``plain_name`` folds to it."""
    forms = {c: c + c.upper() for c in "abcdefghijklmnopqrstuvwxyz"}
    for code in range(0xAA, 0x10000):
        ch = chr(code)
        if not ch.isalpha():
            continue
        plain = [x for x in unicodedata.normalize("NFKD", ch.lower()) if unicodedata.category(x) != "Mn"]
        if len(plain) == 1 and plain[0].lower() in forms:
            forms[plain[0].lower()] += ch
    # most characters of a text are plain ASCII and fail on the first two letters, without a look at all the others
    return {c: f"[{v[:2]}[[^\\x00-\\x7F]&&[{v[2:]}]]]\\p{{Mn}}*" for c, v in forms.items()}


def plain_name(x: Column) -> Column:
    return norm_space(F.lower(strip_accents(F.lower(x), "NFKD")))


def _loose_pieces(plain: Column) -> Column:
    """Pieces of a pattern that finds a name in any case, with or without accents, over any run of spaces."""
    classes = constant(_letter_classes())

    def piece(ch: Column) -> Column:
        return (
            F.when(ch.between("a", "z"), classes[ch])
            .when(ch == " ", F.lit(SPACES.removeprefix("(?U)")))
            .otherwise(F.concat(F.lit("(?iu:\\Q"), ch, F.lit("\\E)")))
        )

    return F.transform(F.split(plain, ""), piece)


TITLES = ("M.", "M", "Monsieur", "Mons", "Mme", "Madame")


def name_variants(first: Column, last: Column, alias_first: Column, alias_last: Column, compat: bool = False) -> Column:
    """Map of plain spelled variant to its alias form.

    ``compat=True`` reproduces two losses: a title before first and last name drops the first name,
    and a bare ``M`` drops the title.
    """
    def words(*parts) -> Column:
        return F.concat_ws(" ", *parts)

    def entry(text: Column, alias: Column) -> Column:
        return F.struct(plain_name(text).alias("k"), alias.alias("v"))

    full = words(alias_first, alias_last)
    rows = [entry(last, alias_last), entry(words(last, first), words(alias_last, alias_first)), entry(words(first, last), full)]
    shown = {"Mons": "Monsieur"} if compat else {}
    for t in TITLES:
        title = F.lit(shown.get(t, t))
        with_last = words(title, alias_last)
        if compat:
            lossy = full if t == "M" else with_last
            rows += [entry(words(F.lit(t), last), lossy), entry(words(F.lit(t), first, last), lossy)]
        else:
            rows += [entry(words(F.lit(t), last), with_last), entry(words(F.lit(t), first, last), words(title, full))]
    rows.append(entry(first, alias_first))
    # the first variant keeps a spelling that two rules share
    unique = F.aggregate(
        F.array(*rows),
        F.array().cast("array<struct<k:string,v:string>>"),
        lambda acc, e: F.when(F.exists(acc, lambda a: a["k"] == e["k"]), acc).otherwise(F.concat(acc, F.array(e))),
    )
    return F.map_from_entries(F.filter(unique, lambda e: e["k"] != ""))


def name_rules(changes: DataFrame, doc_id: str, compat: bool = False) -> DataFrame:
    """``doc_id, pattern, aliases``: how to find and replace a document's person in free text."""

    def at(path: str, column: str) -> Column:
        return F.max(F.when(F.col("path") == path, F.col(column)))

    names = changes.where("mapped").groupBy(doc_id).agg(
        at(f"{PERSON}.prenomUtilise", "original").alias("first"), at(f"{PERSON}.nomUtilise", "original").alias("last"),
        at(f"{PERSON}.prenomUtilise", "alias").alias("a_first"), at(f"{PERSON}.nomUtilise", "alias").alias("a_last"),
    )
    filled = names.where("coalesce(first, '') <> '' AND coalesce(last, '') <> ''")
    aliases = filled.withColumn("aliases", name_variants(F.col("first"), F.col("last"), F.col("a_first"), F.col("a_last"), compat))
    blank = F.lit(SPACES.removeprefix("(?U)"))
    f, l = F.col("f"), F.col("l")
    titles = F.lit("(?iu:" + "|".join(f"\\Q{t}\\E" for t in sorted(TITLES, key=len, reverse=True)) + ")")
    single = F.when(F.length(F.col("first")) > F.length(F.col("last")), F.concat(f, F.lit("|"), l)).otherwise(F.concat(l, F.lit("|"), f))
    # a match begins with a title or a name; other places are passed by before their word bounds are looked at
    ahead = F.concat(F.lit("(?=(?iu:M)|"), F.col("f1"), F.lit("|"), F.col("l1"), F.lit(")"))
    pattern = F.concat(
        F.lit("(?U)"), ahead, F.lit(r"\b(?:"), titles, blank, F.lit("(?:"), f, blank, l, F.lit("|"), l, F.lit(")|"),
        f, blank, l, F.lit("|"), l, blank, f, F.lit("|"), single, F.lit(r")\b"),
    )
    pieces = aliases.withColumns({p: _loose_pieces(plain_name(F.col(c))) for p, c in (("fs", "first"), ("ls", "last"))})
    loose = pieces.select(
        "*", F.array_join("fs", "").alias("f"), F.array_join("ls", "").alias("l"), F.get("fs", F.lit(0)).alias("f1"), F.get("ls", F.lit(0)).alias("l1")
    )
    return loose.select(doc_id, pattern.alias("pattern"), "aliases")


def substitute(text: Column, pattern: Column, replace, found: Column | None = None) -> Column:
    """Replace every match in one left-to-right pass, so a replacement is never replaced again.

    ``found`` may hold the matches if they are already computed.
    """
    found = F.regexp_extract_all(text, pattern, F.lit(0)) if found is None else found
    kept = F.split(text, pattern, -1)
    # the kept pieces number one more than the matches
    tails = F.concat(F.transform(found, replace), F.array(F.lit("")))
    return F.array_join(F.zip_with(kept, tails, lambda a, b: F.concat(a, b)), "")


def mask_names(texts: DataFrame, rules: DataFrame, doc_id: str, text: str = "value") -> DataFrame:
    """Replace the person's name in free text; adds ``seen array<struct<alias, original>>``."""
    joined = texts.join(grows(rules), doc_id, "left").withColumn(
        "found", F.regexp_extract_all(F.col(text), F.col("pattern"), F.lit(0))
    )

    def alias(m: Column) -> Column:
        return F.col("aliases")[plain_name(m)]

    seen = F.transform(F.array_distinct("found"), lambda m: F.struct(alias(m).alias("alias"), m.alias("original")))
    masked = substitute(F.col(text), F.col("pattern"), alias, F.col("found"))
    return (
        joined.withColumn("seen", seen)
        .withColumn(text, F.when(F.size("found") > 0, masked).otherwise(F.col(text)))
        .drop("pattern", "aliases", "found")
    )


def is_free_text() -> Column:
    """String leaves outside the person's own and contact sections."""
    return (F.col("type") == "string") & ~F.col("path").rlike(r"^(usager|contacts)($|[.\[])")


def mask_leaves(leaves: DataFrame, rules: DataFrame, doc_id: str) -> DataFrame:
    joined = mask_names(leaves.withColumn("_t", F.when(is_free_text(), F.col("value"))), rules, doc_id, "_t")
    return joined.withColumn("value", F.coalesce("_t", "value")).drop("_t")


def seen_aliases(masked: DataFrame, doc_id: str) -> DataFrame:
    """``doc_id, alias, original``: every spelling that was masked, none overwritten."""
    return masked.where(F.size("seen") > 0).select(doc_id, F.inline("seen")).distinct()


def mapping_by_doc(mapping: DataFrame, doc_id: str) -> DataFrame:
    """``doc_id, mapping map<alias, original>``; a document's mapping is as small as its record.

    An alias with several spellings gets the one that a record field holds (``field`` true, if there is
    such a column), else the last one in order.
    """
    proper = F.coalesce(F.col("field"), F.lit(False)) if "field" in mapping.columns else F.lit(False)
    pairs = mapping.select(doc_id, "alias", "original", proper.alias("field")).distinct()
    one = pairs.groupBy(doc_id, "alias").agg(F.max_by("original", F.struct("field", "original")).alias("original"))
    return one.groupBy(doc_id).agg(F.map_from_entries(F.collect_list(F.struct("alias", "original"))).alias("mapping"))


_WORDLIKE = r"^[\wÀ-ÖØ-öø-ÿ]+(?:[ '\-][\wÀ-ÖØ-öø-ÿ]+)*$"


def deanonymize(text: Column, mapping: Column) -> Column:
    """Put the originals back: symbol-like aliases first, then word-like ones between word bounds."""

    def choices(word: bool) -> Column:
        keys = F.filter(F.map_keys(mapping), lambda k: (k != "") & (k.rlike("(?U)" + _WORDLIKE) == F.lit(word)))
        longest = F.array_sort(keys, lambda a, b: F.length(b) - F.length(a))
        return F.transform(longest, lambda k: F.concat(F.lit("\\Q"), k, F.lit("\\E")))

    def swap(t: Column, keys: Column, before: str, after: str) -> Column:
        pattern = F.concat(F.lit(before), F.array_join(keys, "|"), F.lit(after))
        return F.when(F.size(keys) > 0, substitute(t, pattern, lambda m: mapping[m])).otherwise(t)

    return let(
        swap(text, choices(False), "(?:", ")"),
        lambda t: swap(t, choices(True), r"(?U)(?<!\w)(?:", r")(?!\w)"),
    )


def reverse_mapping(mapping: DataFrame, doc_id: str, order: str = "seq") -> DataFrame:
    """``original -> alias``; the last entry wins when an original has several aliases."""
    return mapping.groupBy(doc_id, "original").agg(F.max_by("alias", order).alias("alias"))


def session_mapping(entries: DataFrame, session: str, order: str) -> DataFrame:
    """Current mapping of a session: entries of its latest version. Answers live in their own table."""
    latest = entries.groupBy(session).agg(F.max(order).alias(order))
    return entries.join(latest, [session, order], "left_semi")
