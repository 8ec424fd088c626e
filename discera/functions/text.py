"""Text functions as Column expressions: folding, slugs, labels, reference grades, dates, URLs, budgets."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: accented letters of the Latin alphabets in use, and what they fold to
ACCENTED = "áàâäãåéèêëíìîïóòôöõúùûüñçýÿÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇÝ"
PLAIN = "aaaaaaeeeeiiiiooooouuuuncyyAAAAAAEEEEIIIIOOOOOUUUUNCY"

# fixed values: words that carry no identity (articles, demonstratives, prepositions, conjunctions)
STOPWORDS = """el la los las lo un una unos unas de del al y o u a en con por para sobre que se su sus mi tu
este esta estos estas ese esa esos esas aquel aquella aquellos aquellas""".split()
# fixed values: pronouns of the first and second person, endings of the first person plural
FIRST_PERSON = "yo mi me conmigo mio mia mios mias nosotros nosotras nos nuestro nuestra nuestros nuestras".split()
SECOND_PERSON = "vos tu te ti contigo tuyo tuya tuyos tuyas usted ustedes ud uds vosotros vosotras os su sus le les".split()
PLURAL_ENDINGS = ("emos", "amos", "imos", "remos")
# fixed values: names of the speaker's and the addressee's position
SPEAKER = ("enunciador", "enunciadora", "enunciante", "el que enuncia")
ADDRESSEE = "enunciatario enunciataria enunciatarios enunciatarias auditorio destinatario destinatarios destinataria destinatarias publico audiencia".split()
# fixed values: signs that neither open nor close a label; segments that are no entity
EDGES = " \t\r\n\"'“”‘’.,;:!¡¿?«»-–—_*"
ARTICLES = "el la los las un una unos unas lo su sus".split()
MONTHS = "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split()
SLUG_CHARS = 64
# fixed values: slugs that are a pronoun, beginnings that name a role, and what stands for an unknown referent
PRONOUNS = "yo vos ustedes vosotros".split()
ROLE_BEGINNINGS = "nosotros nosotras nuestro nuestra enunciador enunciadora enunciante enunciatario enunciataria enunciatarios enunciatarias auditorio destinatario destinatarios".split()
ROLE_LABELS = "enunciador enunciatario actor auditorio destinatario prodestinatario paradestinatario contradestinatario".split()
UNKNOWN = ("", "no identificado", "no_identificado", "no identificada", "no se identifica", "no_se_identifica", "ninguno", "ninguna", "?", "desconocido", "desconocida")
# fixed values: patterns that part or govern labels: alternatives, enumerations, periphrases, conjunctions, prepositions, possessives
ALTERNATIVES = r"\s*(?:/|\||\sy/o\s|\so\s)\s*"
ENUMERATION = r"\s*[,;:]\s*"
PERIPHRASIS = r"(?i)^(?:sentirse|sentir|estar|sentimiento\s+de|emoci[oó]n\s+de)\s+"
CONJUNCTION = r"(?iU)\b(?:y|e|o|u)\b"
COORDINATION = r"(?iU)\s*(?:,|\by\b|\be\b|\bo\b|\bu\b)\s*"
GOVERNING = r"(?iU)\b(?:entre|con|contra|junto a|frente a)\s+\S"
POSSESSIVE = r"(?is)^(?:su|sus)\s+(.+)$"
DETERMINERS = "el|la|los|las|un|una|unos|unas"
SPANISH_DATE = r"(\d{1,2})\s+de\s+([a-z]+)[\s,]+(?:de\s+)?(\d{4})"
EUROPEAN_DATE = r"(\d{1,2})[-/](\d{1,2})[-/]\d{4}"


def fold_value(text: str | None) -> str:
    """The same folding of one Python string, by Unicode decomposition."""
    return "".join(c for c in unicodedata.normalize("NFKD", text or "") if not unicodedata.combining(c)).lower()


def blank_to_null(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


def fold_letters(c: Column) -> Column:
    """Lower case, accented Latin letters without their accents; accents that are characters of their own stay; null is empty."""
    return F.lower(F.translate(F.coalesce(c, F.lit("")), ACCENTED, PLAIN))


def fold(c: Column) -> Column:
    """Lower case without the accents of Latin letters; null is empty."""
    marks = "".join(map(chr, range(0x300, 0x370)))
    return F.translate(fold_letters(c), marks, "")


def slug(c: Column) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(fold(c), "[^a-z0-9]+", "_"), "^_|_$", ""), 1, SLUG_CHARS)


def canonical_slug(c: Column) -> Column:
    """A slug without its stop words."""
    words = F.filter(F.split(fold(c), "[^a-z0-9]+"), lambda w: (w != "") & ~w.isin(STOPWORDS))
    return F.substring(F.array_join(words, "_"), 1, SLUG_CHARS)


def _first(c: Column, pattern: str) -> Column:
    return F.element_at(F.split(F.coalesce(c, F.lit("")), pattern, 2), 1)


def _squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def sanitize_referent(c: Column) -> Column:
    """The first alternative of a referent label, without the signs at its edges."""
    return _squeeze(F.btrim(_first(c, ALTERNATIVES), F.lit(EDGES)))


def sanitize_emotion(c: Column) -> Column:
    """One emotion's name: the first alternative of the first item, without a periphrasis."""
    one = F.btrim(_first(_first(c, ALTERNATIVES), ENUMERATION), F.lit(EDGES))
    bare = F.regexp_replace(one, PERIPHRASIS, "")
    return _squeeze(F.btrim(bare, F.lit(EDGES)))


def split_coordination(c: Column) -> Column:
    """The entities that a coordinated text names; whole where there is no conjunction, or a preposition of the first part governs the list."""
    t = F.trim(F.coalesce(c, F.lit("")))
    parts = F.transform(F.split(t, COORDINATION), lambda p: F.trim(p))
    parts = F.filter(parts, lambda p: (F.length(p) >= 3) & ~F.lower(p).isin(ARTICLES))
    low = F.transform(parts, F.lower)
    unique = F.filter(parts, lambda p, i: F.array_position(low, F.lower(p)) == i + 1)
    governed = F.coalesce(F.get(parts, F.lit(0)), F.lit("")).rlike(GOVERNING)
    plain = ~t.rlike(CONJUNCTION) | governed | (F.size(unique) < 2)
    return F.when(t == "", F.array().cast("array<string>")).when(plain, F.array(t)).otherwise(unique)


def resolve_possessive(parts: Column) -> Column:
    """su X, in a later part, is X de the first part."""
    first = F.trim(F.get(parts, F.lit(0)))
    own = lambda p: F.regexp_extract(F.trim(p), POSSESSIVE, 1)
    return F.transform(parts, lambda p, i: F.when((i > 0) & (own(p) != "") & (first != ""), F.concat(F.trim(own(p)), F.lit(" de "), first)).otherwise(p))


def _deictic_base(c: Column) -> Column:
    return F.trim(F.btrim(F.trim(F.regexp_replace(fold(c), r"\(.*?\)", "")), F.lit("'\"")))


def is_first_person(c: Column) -> Column:
    return _deictic_base(c).isin(FIRST_PERSON)


def is_deictic(c: Column) -> Column:
    """A pronoun of the first or second person among the words, or a verb in the first person plural."""
    ending = "(" + "|".join(PLURAL_ENDINGS) + ")$"
    return F.exists(F.split(_deictic_base(c), "[^a-z0-9]+"), lambda w: w.isin(FIRST_PERSON + SECOND_PERSON) | ((F.length(w) > 4) & w.rlike(ending)))


def resolve_role(inference: Column, speaker: Column, addressees: Column) -> Column:
    """Who stands behind a role label: the speaker, or the only addressee; empty where nobody is known."""
    s = F.regexp_replace(_deictic_base(inference), rf"^(?:{DETERMINERS})\s+", "")
    named = F.filter(F.transform(F.coalesce(addressees, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(s.isin(*SPEAKER), F.trim(F.coalesce(speaker, F.lit("")))).when(s.isin(ADDRESSEE) & (F.size(named) == 1), F.get(named, F.lit(0))).otherwise("")


def invalid_canonical(c: Column) -> Column:
    """A slug that cannot name one entity: a pronoun, a role, or two entities."""
    return F.coalesce(c, F.lit("")).rlike(rf"^({'|'.join(PRONOUNS)})$|^({'|'.join(ROLE_BEGINNINGS)})(_|$)|_[ye]_")


def is_unknown(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c, F.lit("")))).isin(*UNKNOWN)


def is_role_label(c: Column) -> Column:
    """A label that names a position in the analysis and no referent."""
    return F.regexp_replace(slug(c), "^((el|la|los|las|un|una)(_|$))+", "").rlike(rf"^({'|'.join(ROLE_LABELS)})(_|$)")


def clean_whitespace(c: Column) -> Column:
    """Runs of blanks are one; lines are trimmed; single blank lines stay."""
    lines = F.transform(F.split(F.replace(F.coalesce(c, F.lit("")), F.lit("\u00a0"), F.lit(" ")), r"\r\n|\r|\n", -1), lambda x: F.regexp_replace(F.trim(F.regexp_replace(x, r"[ \t]+", " ")), r"^\s+|\s+$", ""))
    joined = F.array_join(lines, "\n")
    return F.regexp_replace(F.regexp_replace(joined, r"\n{3,}", "\n\n"), r"^\n+|\n+$", "")


def strip_boilerplate(c: Column, lines: list[str]) -> Column:
    known = [x.lower() for x in lines]
    return F.btrim(F.array_join(F.filter(F.split(c, "\n", -1), lambda x: ~F.lower(F.trim(x)).isin(known)), "\n"), F.lit(" \t\n\r"))


def normalize_url(url: Column, base: str = "") -> Column:
    u = F.trim(F.coalesce(url, F.lit("")))
    absolute = u.startswith("http://") | u.startswith("https://") | (u == "")
    return F.when(absolute | F.lit(not base), u).otherwise(F.concat(F.lit(base.rstrip("/")), F.when(u.startswith("/"), u).otherwise(F.concat(F.lit("/"), u))))


def domain(url: Column) -> Column:
    host = F.lower(F.regexp_extract(F.regexp_replace(url, "^https?://", ""), "^([^/?]*)", 1))
    return F.regexp_replace(host, r"^www\.", "")


def estimate_tokens(c: Column) -> Column:
    return F.ceil(F.length(F.coalesce(c, F.lit(""))) / 3)


def truncate_to_budget(c: Column, tokens: int) -> Column:
    """The head of a text that fits the budget, cut at a word, with an ellipsis."""
    head = F.regexp_replace(F.substring(c, 1, tokens * 3), r"\s+\S*\z", "")
    return F.when(estimate_tokens(c) <= tokens, c).otherwise(F.concat(F.rtrim(head), F.lit("…")))


def truncate_tail(c: Column, tokens: int) -> Column:
    """The tail of a text that fits the budget, from a word's start on, after an ellipsis."""
    tail = F.regexp_replace(F.right(c, F.lit(tokens * 3)), r"^\S*\s+", "")
    return F.when(estimate_tokens(c) <= tokens, c).otherwise(F.concat(F.lit("…"), F.ltrim(tail)))


def pseudonym(handle: Column, salt: str, chars: int = 10) -> Column:
    return F.concat(F.lit("u_"), F.substring(F.sha2(F.concat(F.lit(salt + ":"), F.lower(handle)), 256), 1, chars))


def cache_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|||", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)


# fixed values: pronouns and determiners that refer without naming
PRONOUNS = """yo mi me conmigo mio mia mios mias nosotros nosotras nos nuestro nuestra nuestros nuestras vos tu te ti usted ustedes ud uds
vosotros vosotras os su sus le les el ella ellos ellas esto eso aquello este ese aquel""".split()


def lexical_modality(mark: Column) -> Column:
    """referencia_gramatical where a mark, without what is in parentheses, is made of pronouns alone; null where only a model can tell."""
    words = F.filter(F.split(F.regexp_replace(fold(mark), r"\(.*?\)", ""), "[^a-z0-9]+"), lambda w: w != "")
    return F.when((F.size(words) > 0) & F.forall(words, lambda w: w.isin(PRONOUNS)), "referencia_gramatical")


def stable_tone(name: Column, tones: int = 7) -> Column:
    return F.crc32(fold(F.trim(name))) % tones


def token_overlap(a: Column, b: Column) -> Column:
    """Shared words over the words of the shorter side."""
    x, y = (F.array_distinct(F.filter(F.split(fold(c), "[^a-z0-9]+"), lambda w: w != "")) for c in (a, b))
    least = F.least(F.size(x), F.size(y))
    return F.when(least > 0, F.size(F.array_intersect(x, y)) / least).otherwise(F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(F.lit(0.0))


def classify_reference(a: Column, b: Column, canonical_a: Column | None = None, canonical_b: Column | None = None) -> Column:
    """How two references compare: identico, mismo_canonico, solapamiento_parcial, distinto, valor_ausente."""
    x, y = slug(a), slug(b)
    words = lambda s: F.filter(F.split(s, "_"), lambda w: (w != "") & ~w.isin(STOPWORDS))
    name = lambda label, given: F.coalesce(F.nullif(canonical_slug(given), F.lit("")), canonical_slug(label)) if given is not None else canonical_slug(label)
    p, q = name(a, canonical_a), name(b, canonical_b)
    return (
        F.when((x == "") | (y == ""), "valor_ausente").when(x == y, "identico").when((p != "") & (p == q), "mismo_canonico")
        .when(F.arrays_overlap(words(x), words(y)), "solapamiento_parcial").otherwise("distinto")
    )


def normalize_date(c: Column) -> Column:
    """ISO, day/month/year or Spanish words as an ISO date; empty where it is none."""
    t = F.trim(F.coalesce(c, F.lit("")))
    iso = F.try_to_date(F.regexp_extract(t, r"^(\d{4}-\d{2}-\d{2})", 1), "yyyy-MM-dd")
    dmy = F.regexp_extract(t, EUROPEAN_DATE, 0)
    numbers = F.split(dmy, "[-/]")
    european = F.try_to_date(F.when(dmy != "", F.concat_ws("-", F.get(numbers, F.lit(2)), F.lpad(F.get(numbers, F.lit(1)), 2, "0"), F.lpad(F.get(numbers, F.lit(0)), 2, "0"))), "yyyy-MM-dd")
    pattern, low = SPANISH_DATE, fold(t)
    name = F.when(F.regexp_extract(low, pattern, 2) == "setiembre", "septiembre").otherwise(F.regexp_extract(low, pattern, 2))
    month = F.array_position(F.array(*map(F.lit, MONTHS)), name)
    spanish = F.try_to_date(F.when(month > 0, F.concat_ws("-", F.regexp_extract(low, pattern, 3), F.lpad(month.cast("string"), 2, "0"), F.lpad(F.regexp_extract(low, pattern, 1), 2, "0"))), "yyyy-MM-dd")
    return F.coalesce(F.date_format(F.coalesce(iso, european, spanish), "yyyy-MM-dd"), F.lit(""))


def split_values(c: Column) -> Column:
    """A cell of values parted by semicolons: trimmed, lowered, each once, in order."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ";"), lambda x: F.lower(F.trim(x))), lambda x: x != ""))


def sorted_pairs(c: Column) -> Column:
    """All pairs a < b of a list's distinct values."""
    s = F.array_sort(F.array_distinct(c))
    nested = F.transform(s, lambda a, i: F.transform(F.slice(s, i + 2, F.size(s)), lambda b: F.struct(a.alias("a"), b.alias("b"))))
    return F.flatten(nested)


def cosine(a: Column, b: Column) -> Column:
    """The inner product of unit vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def literal_mark(mark: Column, text: Column) -> Column:
    """Whether a mark's words stand in a text one after another, folded."""
    words = lambda c: F.concat(F.lit(" "), F.trim(F.regexp_replace(fold(c), r"[^a-z0-9]+", " ")), F.lit(" "))
    return (words(mark) != "  ") & F.contains(words(text), words(mark))


def describe(*parts: Column) -> Column:
    """The given parts of a record in order, without the blank ones."""
    return F.concat_ws(" · ", *map(blank_to_null, parts))


def rate_limit_wait(header: Column, now: Column) -> Column:
    """Seconds to wait by a reset header, an epoch or an ISO time: 5 at least, 60 where it says nothing."""
    epoch = header.try_cast("double")
    iso = F.try_to_timestamp(header).cast("double")
    wait = F.coalesce(epoch, iso) - now.cast("double")
    return F.when(wait.isNull(), 60.0).otherwise(F.greatest(wait, F.lit(5.0)))


def embedded_quote(raw: Column) -> Column:
    """The post that a quote carries in its own JSON (texto, autor_handle, uri); its record may lie one level deeper. Null where there is none."""
    v = F.try_parse_json(raw)
    get = lambda p: F.try_variant_get(v, p, "string")
    deep = F.try_variant_get(v, "$.embed.record.value", "variant").isNull()
    at = lambda p: F.when(deep, get(f"$.embed.record.record.{p}")).otherwise(get(f"$.embed.record.{p}"))
    text = F.trim(F.coalesce(at("value.text"), F.lit("")))
    handle = F.regexp_replace(F.coalesce(at("author.handle"), F.lit("")), "^@+", "")
    return F.when(text != "", F.struct(text.alias("texto"), F.when(handle != "", handle).otherwise("?").alias("autor_handle"), F.coalesce(at("uri"), F.lit("")).alias("uri")))


def map_update(extra: Column, changes: Column) -> Column:
    """A JSON object of texts with some keys set anew; bad JSON counts as empty."""
    old = F.coalesce(F.from_json(extra, "map<string,string>"), F.create_map().cast("map<string,string>"))
    return F.to_json(F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(changes, k)), changes))
