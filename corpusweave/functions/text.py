"""Text, URL and identifier functions as column expressions; all stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Results depend on these being exactly so.
CATEGORY_KEYWORDS = (
    ("Bosses", "boss"), ("Creatures", "boss"), ("Enemies", "boss"), ("NPCs", "quest"), ("Merchants", "quest"),
    ("Side Quests", "quest"), ("Quests", "quest"), ("Walkthrough", "quest"), ("Endings", "quest"), ("Crafting", "quest"),
    ("Locations", "location"), ("Sites of Grace", "location"), ("Legacy Dungeons", "location"), ("Lore", "lore"),
    ("Weapons", "item"), ("Armor", "item"), ("Shields", "item"), ("Talismans", "item"), ("Sorceries", "item"),
    ("Incantations", "item"), ("Spirit Ashes", "item"), ("Ashes of War", "item"), ("Skills", "item"), ("Upgrades", "item"),
    ("Key Items", "item"), ("Consumables", "item"), ("Stats", "lore"), ("Status Effects", "lore"), ("Classes", "lore"),
    ("Character", "lore"), ("General Information", "lore"),
)
NAV_TERMS = (
    "daggers", "straight swords", "greatswords", "colossal swords", "colossal weapons", "thrusting swords",
    "heavy thrusting swords", "light greatswords", "curved swords", "curved greatswords", "katanas", "great katanas",
    "twinblades", "axes", "greataxes", "hammers", "great hammers", "flails", "spears", "great spears", "halberds",
    "reapers", "whips", "fists", "claws", "hand-to-hand arts", "backhand blades", "beast claws", "perfume bottles",
    "throwing blades", "bows", "light bows", "greatbows", "crossbows", "ballistas", "glintstone staffs", "sacred seals",
    "torches", "small shields", "medium shields", "greatshields", "thrusting shields", "shields", "helms", "chest armor",
    "gauntlets", "leg armor", "helm", "gauntlet", "greaves", "weapons", "armor", "talismans", "sorceries", "incantations",
    "spirit ashes", "ashes of war", "skills", "items", "magic", "equipment", "spells", "creatures", "bosses", "npcs",
    "locations", "maps", "classes",
)
GRADES = {"S": 6, "A": 5, "B": 4, "C": 3, "D": 2, "E": 1}
WEAPON_TYPES = {"glinstone staves": "Glintstone Staffs", "glintstone staves": "Glintstone Staffs", "ballistas": "Ballistae"}
DLC_MARKERS = ("shadow of the erdtree", "realm of shadow", "land of shadow")
AFFIRM_STARTERS = ("yes", "yeah", "yep", "yup", "sure", "ok", "okay", "please", "go", "do", "continue", "proceed", "absolutely", "definitely", "that", "sounds")
AFFIRM_WORDS = (*AFFIRM_STARTERS, "ahead", "it", "for", "on", "good", "works", "carry", "thanks", "great")
SUPERLATIVES = (("heaviest", "weight_desc"), ("lightest", "weight_asc"), ("cheapest", "fp_cost_asc"))
SUPERLATIVE_GROUPS = (
    (r"\bsorcer", "Sorceries"),
    (r"\bincantation", "Incantations"),
    (r"\barmou?r|\bhelm|\bgauntlet|\bgreaves|\bchest\b|\bleg armou?r", "Armor"),
    (r"\bweapon|\bsword|\bkatana|\bgreatsword|\baxe|\bspear|\bhalberd|\bdagger|\bhammer|\bbow|\bstaff|\bseal|\bfist|\bwhip|\breaper|\bflail|\btwinblade", "Weapons"),
)
FILE_ENDINGS = (".jpg", ".jpeg", ".png", ".gif", ".webp", ".svg", ".ico", ".pdf")
SKIP_FRAGMENTS = ("action=", "/Shop", "/forums", "/news", "/blog", "?", "#")
MIN_CHUNK_CHARS = 80
WALKTHROUGH_CHARS = 50_000
PLACEHOLDER = r"(?i)\[\s*other\s+\w+\s+go\s+here\s*\]"
SENTENCE_END = r"(?<=[.!?])\s+"
EDGE = r"(?U)^\s+|\s+$"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def strip(x: Column) -> Column:
    """Without white space at both ends, of any Unicode kind."""
    return F.regexp_replace(x, EDGE, "")


def strip_long(x: Column) -> Column:
    """As ``strip``, for a long text that is at hand: its ends are looked at first."""
    return F.when(F.concat(F.substring(x, 1, 1), F.substring(x, -1, 1)).rlike(r"(?U)\s"), strip(x)).otherwise(x)


def normalise(x: Column) -> Column:
    """One space for no-break spaces and runs of blanks, two line ends at most, stripped."""
    x = F.replace(x, F.lit("\xa0"), F.lit(" "))
    x = F.regexp_replace(x, r"[ \t]+", " ")
    return strip(F.regexp_replace(x, r"\n{3,}", "\n\n"))


def collapse(x: Column) -> Column:
    """Words joined by single spaces."""
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def norm_text(x: Column) -> Column:
    """Lowered, all but a-z and 0-9 to spaces, collapsed."""
    return F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "))


def norm_commas(x: Column) -> Column:
    """Lowered, commas to spaces, collapsed: how mentions and candidates are compared."""
    return collapse(F.replace(F.lower(x), F.lit(","), F.lit(" ")))


def norm_quotes(x: Column) -> Column:
    """As ``norm_commas``, with curly single quotes made straight: how expectations are compared."""
    return norm_commas(F.translate(x, "\u2019\u2018", "''"))


def chunk_id(url: Column, kind: Column, index: Column) -> Column:
    return F.substring(F.md5(F.concat_ws("|", url, kind, index.cast("string")).cast("binary")), 1, 16)


def point_id(chunk: Column) -> Column:
    """Sixteen hexadecimal digits as an unsigned 64-bit number."""
    return F.conv(chunk, 16, 10).cast("decimal(20,0)")


def content_hash(url: Column, raw: Column) -> Column:
    return F.md5(F.concat(url, F.lit("\n"), raw).cast("binary"))


def slug_name(url: Column) -> Column:
    """The last path segment with plus signs as spaces and percent signs decoded."""
    last = F.element_at(F.split(F.regexp_replace(url, "/+$", ""), "/"), -1)
    return strip(F.coalesce(F.try_url_decode(F.replace(last, F.lit("+"), F.lit(" "))), last))


def clean_heading(heading: Column, title: Column, site: str) -> Column:
    """Without the first that leads it of site and title, title, and site; ``Overview`` if nothing is left."""
    h = strip(heading)
    edges = "^[ \\-\u2013\u2014:\u00b7|]+|[ \\-\u2013\u2014:\u00b7|]+$"

    def cut(prefix: Column, otherwise: Column) -> Column:
        return F.when(F.startswith(F.lower(h), F.lower(prefix)), F.regexp_replace(F.substr(h, F.length(prefix) + 1), edges, "")).otherwise(otherwise)

    out = cut(F.concat(F.lit(f"{site} "), title), cut(title, cut(F.lit(site), h)))
    return F.when(out == "", F.lit("Overview")).otherwise(out)


def context_prefix(breadcrumb: Column, title: Column, section: Column) -> Column:
    path = F.array_join(F.filter(F.concat(breadcrumb, F.array(title)), lambda p: p != ""), " / ")
    low = F.lower(section)
    named = (F.coalesce(section, F.lit("")) != "") & (low != "overview") & (low != F.lower(title))
    return F.concat(F.lit("["), path, F.when(named, F.concat(F.lit(" \u00b7 "), section)).otherwise(F.lit("")), F.lit("]"))


def context_block(title: Column, section: Column, raw: Column) -> Column:
    named = (F.coalesce(section, F.lit("")) != "") & (F.lower(section) != "overview")
    return F.concat(F.lit("=== "), title, F.when(named, F.concat(F.lit(" \u00b7 "), section)).otherwise(F.lit("")), F.lit(" ===\n"), raw)


def sections(body: Column) -> Column:
    """(heading, content) of each part between ``## `` lines; what comes first is ``Overview``; empty ones go."""
    parts = F.split(F.concat(F.lit("## Overview\n"), body), r"(?m)^## ")
    pairs = F.transform(
        F.filter(F.slice(parts, F.lit(2), F.lit(1 << 30)), lambda p: F.length(p) > 0),
        lambda p: F.struct(strip(F.substring_index(p, "\n", 1)).alias("heading"), F.when(F.contains(p, F.lit("\n")), F.substr(p, F.instr(p, F.lit("\n")) + 1)).otherwise(F.lit("")).alias("content")),
    )
    pairs = F.transform(pairs, lambda s: F.struct(s["heading"].alias("heading"), strip_long(s["content"]).alias("content")))
    return F.filter(pairs, lambda s: s["content"] != "")


def sentences(x: Column) -> Column:
    return F.split(x, SENTENCE_END)


def drop_adjacent(parts: Column) -> Column:
    """Parts that differ from the one before, case and outer blanks aside."""

    def kept(pairs: Column) -> Column:
        new = F.filter(pairs, lambda p, i: (i == 0) | (p["key"] != F.element_at(pairs, F.greatest(i, F.lit(1)))["key"]))
        return F.transform(new, lambda p: p["part"])

    return let(F.transform(parts, lambda p: F.struct(p.alias("part"), F.lower(strip(p)).alias("key"))), kept)


def keep_passage(raw: Column, allow_short: Column | None = None) -> Column:
    """Long enough, or allowed to be short, and no template placeholder."""
    long = F.length(raw) >= MIN_CHUNK_CHARS
    long = long | allow_short if allow_short is not None else long
    return (raw != "") & long & ~raw.rlike(PLACEHOLDER)


def is_dlc(body: Column) -> Column:
    intro = F.lower(F.substring(body, 1, 2000))
    out = F.lit(False)
    for marker in DLC_MARKERS:
        out = out | F.contains(intro, F.lit(marker))
    return F.coalesce(out, F.lit(False))


def category(breadcrumb: Column, default: Column) -> Column:
    """The deepest segment's first keyword decides."""

    def one(segment: Column) -> Column:
        low = F.lower(segment)
        return F.coalesce(*(F.when(F.contains(low, F.lit(k.lower())), F.lit(v)) for k, v in CATEGORY_KEYWORDS))

    found = F.filter(F.transform(F.reverse(breadcrumb), one), lambda c: c.isNotNull())
    return F.coalesce(F.get(found, F.lit(0)), default)


def doc_type(title: Column, body_length: Column) -> Column:
    """Also what a breadcrumb names a walkthrough is one only from the length on that makes any page one."""
    return F.when(title.rlike("(?i)walkthrough|game progress route") | (body_length >= WALKTHROUGH_CHARS), "walkthrough").otherwise("page")


def is_nav_list(x: Column) -> Column:
    segments = F.filter(F.transform(F.split(x, "\u2666"), strip), lambda s: s != "")
    upper = F.filter(segments, lambda s: F.substring(s, 1, 1).rlike(r"^\p{Lu}"))
    return (F.size(F.split(x, "\u2666")) >= 3) & (F.size(segments) >= 2) & (F.size(upper) > 0.7 * F.size(segments))


def is_category_nav(items: Column) -> Column:
    hits = F.filter(items, lambda i: F.lower(strip(i)).isin(*NAV_TERMS))
    return (F.size(items) >= 4) & (F.size(hits) >= 0.6 * F.size(items))


def is_mashed(key: Column, value: Column) -> Column:
    """Stat grids run together into one token."""

    def crammed(s: Column) -> Column:
        return (F.regexp_count(s, F.lit(r"\d+")) >= 2) & (F.regexp_count(s, F.lit(" ")) <= 1)

    return crammed(key) | crammed(value) | (key.rlike("(Scaling|Requires)[A-Z].*[A-Z]") & ~F.contains(key, F.lit(" ")))


def absolute(href: Column, base: str) -> Column:
    """A clean absolute URL, or null."""
    h = strip(href)
    full = F.when(F.startswith(h, F.lit("//")), F.concat(F.lit("https:"), h)).when(F.startswith(h, F.lit("/")), F.concat(F.lit(base), h)).when(F.startswith(h, F.lit("http")), h)
    return F.nullif(F.regexp_replace(F.substring_index(full, "#", 1), "/+$", ""), F.lit(""))


def content_url(url: Column, host: str, skip_paths: tuple[str, ...] = ()) -> Column:
    """Whether a URL is a content page of ``host``: no file, query, or path and fragment to skip."""
    path = F.regexp_replace(F.regexp_extract(url, r"^[a-z]+://[^/?#]*([^?#]*)", 1), "/+$", "")
    netloc = F.regexp_extract(url, r"^[a-z]+://([^/?#]*)", 1)
    ok = (netloc == host) & (path != "") & ~F.startswith(path, F.lit("/file/")) & ~F.lower(path).rlike("(" + "|".join(e.replace(".", r"\.") for e in FILE_ENDINGS) + ")$")
    for fragment in SKIP_FRAGMENTS:
        ok = ok & ~F.contains(url, F.lit(fragment))
    return F.coalesce(ok & ~path.isin(*skip_paths) if skip_paths else ok, F.lit(False))


def grade(letter: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in GRADES.items() for x in kv)), letter)


def weapon_type(leaf: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in WEAPON_TYPES.items() for x in kv))
    return F.coalesce(F.try_element_at(table, F.lower(F.trim(leaf))), leaf)


def phonetic_skeleton(x: Column) -> Column:
    """First letter, then consonants, repeats collapsed."""
    low = F.lower(x)
    return F.regexp_replace(F.concat(F.substring(low, 1, 1), F.regexp_replace(F.substring(low, 2, 1 << 30), "[aeiou]", "")), r"(.)\1+", "$1")


def is_affirmation(x: Column) -> Column:
    """A short turn of nothing but words of assent, the first of them a starter."""
    t = F.lower(strip(x))
    words = F.regexp_extract_all(t, F.lit("[a-z]+"), F.lit(0))
    return (F.length(t).between(1, 25)) & (F.size(words) > 0) & F.coalesce(F.get(words, F.lit(0)).isin(*AFFIRM_STARTERS), F.lit(False)) & F.forall(words, lambda w: w.isin(*AFFIRM_WORDS))


def superlative_sort(x: Column) -> Column:
    word = F.lower(F.regexp_extract(x, r"(?i)\b(heaviest|lightest|cheapest)\b", 1))
    return F.coalesce(*(F.when(word == w, F.lit(s)) for w, s in SUPERLATIVES))


def superlative_group(x: Column) -> Column:
    return F.when(superlative_sort(x).isNotNull(), F.coalesce(*(F.when(x.rlike(f"(?i){p}"), F.lit(g)) for p, g in SUPERLATIVE_GROUPS)))


def without_follow_up(x: Column) -> Column:
    return strip(F.regexp_replace(x, r"(?i)\s*\(follow[\s-]*up(?:\s+question)?\)\s*$", ""))


def json_object(x: Column) -> Column:
    """From the first opening to the last closing brace, or null."""
    return F.nullif(F.regexp_extract(x, r"(?s)\{.*\}", 0), F.lit(""))
