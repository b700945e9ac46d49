"""Normal forms of phrases and classes of purposes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Normal form -> patterns, one form a line; patterns are parted by " || ". A leading ! forbids,
# a leading = minds case; words are whole unless a pattern is anchored.
DATA_FORMS = r"""
UNSPECIFIED :: ^(some|all|any|variety|category|example|type|kind|thing)$ || ^(data|datum|information|detail|technology)$
personal information :: ^((your|user|the)\s+)?personal (data|info|information|datum)$ || ^personal (data|info|information|datum) (that )?((about|of) (you|yourself|user)|you (provide|enter|submit)|we collect) || =PI || !(cannot|no[nt]?)
personal identifier :: (personal|user) id(entifier)? || (personally|directly)\b.*\bidentif\w+\b.*\b(information|data|datum) || =PII || information\b.*\bidentify\b.*\b(you|individual|person|user) || !(cannot|no[nt]?) || !de-?identif\w+
identifier :: ^identifier$ || ^((other|universally)\s+)?(unique|persistent|other) identifier$ || =^ID$
government identifier :: government(al)?\b.*\bid(entification)? number || government(al)?\b.*\bid(entifier)?
ssn :: social security\b.*\bnumber || =SSN
passport number :: passport\b.*\b(number|detail|no)
driver's license number :: (driving|driver('s)?) license (number|information|copy)
credit / debit card number :: (credit|debit|payment)\b.*\bcard (number|information|detail)
personal characteristic :: (personal|user|demographic|population|physical) characteristic
protected classification :: protect(ed)? classification
date of birth :: date of birth || birth\s*(day|date)
age :: ^age$ || age (range|level|information) || (exact|user) age
gender :: ^(gender|sex)$ || gender information
race / ethnicity :: race || ethnicity
biometric information :: biometrics || biometric\b.*\b(data|information|identifier|detail|technology)
voiceprint :: voiceprint || voice (record(ing)?|pattern)
fingerprint :: fingerprint || !(device|digital|build|system)
geolocation :: ^location$ || (geo-?(graphic)?\s*)?location || (geo-?)?location(al)? (information|data|datum|history|detail) || geographic(al)? (information|data|datum|history|detail) || location (base|relate|specific) || location (mapping|tracking) data || (physical|your) location || !(precise|A?GPS|coarse|non-precise|approximate|broad|country|city)
precise geolocation :: (precise|gps)\b.*\b(geo-?(graphic)?\s*)?location || location coordinate || =A?GPS || (latitude|longitude) || !(non-precise)
coarse geolocation :: (coarse|imprecise|broad|non-precise|approximate|country|city)\b.*\b(geo-?(graphic)?\s*)?location
contact information :: contact\b.*\b(info(rmation)?|data|detail|method) || information\b.*\bused to contact\b.*\byou || !(cannot|no[nt]?) || (customer|emergency) contact$
person name :: (your|first|last|family|middle|given|real|legal|maiden|person|contact|passenger|personal|full|sur|billing)\s*name || ^name$
phone number :: (tele)?phone (mobile )?number || (mobile|fax|contact) number
email address :: (e-?mail|electronic mail)\b.*\b(address|account|address information) || ^e-?mail( id)?$
postal address :: (home|work|postal|physical|residential|street|billing|accurate|shipping|delivery|your|mail|mailing|primary) address || ^address$ || !(e-?mail|electronic mail)
device identifier :: (device|mobile)\b.*\bid(entifier)? || identifier (for|of|link|associate|assign|match|tie|specific)\b.*\bdevice || UDID$ || !(cannot|no[nt]?|advertising)
software identifier :: software\b.*\bid(entifier)?
hardware identifier :: hardware\b.*\bid(entifier)?
imei :: imei || international mobile (equipment |device )id(entification|entity)?
mac address :: mac address(es)? || =MAC || media access control || network card address(es)?
advertising id :: ad(vertis(ing|er))?\b.*\bid(entifier)? || advertising id(entification)? number || id(entifier?)?\b.*\badvertising || (a[ad]id|idfa|gaid|advertisingid)
gsf id :: gsf id
android id :: android[_\s]?(ud)?id(entifier)? || android device id(entifier)? || SSAID
serial number :: (device|android)('s)? serial (number|no) || ^serial number
sim serial number :: imsi || international mobile subscriber identification number || sim code || iccid
router ssid :: b?ssids? || id(entifier?)?\b.*\brouter || wi[ -]?fi ((end|access)[-\s]?point|name)
ip address :: =IP || internet protocol address
cookie / pixel tag :: cookie || pixel tag || web (beacon|bug) || (clear|transparent|invisible) (gif|graphic|image)s? || (pixel|gif) tag
internet activity :: (internet|website|app(lication)?|in-game|on-?line|player|user|system|network) (activity|usage) || information about (activity|usage|access) || (activity|usage|access) (history|data|datum)
browsing / search history :: (browsing|search|browser?|online) (history|behaviour|behavior|activity)
package dump :: app(lication)? list || package dump || instal (package|app(lication)?|software) || (package|app(lication)?|icon) instal || list of\b.*\b(package|app(lication)?)
non-personal information :: non[- ]*(personally|directly)\b.*\bidentif\w+\b.*\b(information|data) || non[- ]*PII || information\b.*\b(cannot|no[nt]?)\b.*\bidentify\b.*\b(you|individual|person|user) || non-personal\b.*\b(information|data)
aggregate / deidentified / pseudonymized information :: (aggregated?|anonymized|anonymised|anonymous|de-identified) (data|information)
anonymous identifier :: (anonymous|pseudonymous)\b.*\bidentifier
"""
ACTOR_FORMS = r"""
we :: ^(we|us|i)$ || ^our (service|(web)?site|product|server|app(lication|s)?|mobile application|system|software|company|business|platform)$ || ^our\b.*\b(affiliated?|subsidiary|(group )?company) || ^(this|the) (website|site|app(s|lication)?|software|service?|company|owner)$ || (services?|software|app(s|lication)?)\b.*\b(we (offer|provide)) || =^(Company|Softwares?|App(lication)?s?|Products?|Services?|Websites?|Sites?|Games?)$
UNSPECIFIED :: ^(some|all|any|variety|category|example|type|kind|thing)$ || (third|external|outside|other|another)[\s-]?party || ^(affiliate|app|application|business|company|corporation|organi[sz]ation|partner|party|product|provider|service|site|software|subsidiary|vendor|website|agent|entity)$ || !(ad(vertis\w+)?|social|(e-?)?mail|analytics?|measurement|market(ing)?|track(ing)?|content|search|payment|government|auth(entication)?)
advertiser :: ad(vertis\w+)?\b.*\b(provider|network|company|platform|vendor|partner|agency|service|technology|server|sdk|entities) || advertiser
auth provider :: (auth(entication)?|identity|sign-?(on|in))\b.*\b(provider|service) || single sign-?(on|in)
social media :: social (network\w*|medium|media|platform)
analytic provider :: analytics?\b.*\b(provider|company|platform|vendor|partner|service|tool|software|technology) || ^analytics$ || measurement (service|analytics|company|provider) || (business|trend|third[- ]party|site|web|marketing|data) analytics || market research || tracking (tool|utility|service)
content provider :: content (provider|publisher|distributor|partner)
email service provider :: (e-?mail|electronic mail)(ing)?\b.*\b(provider|service|vendor) || provider of\b.*\bemail || service provider\b.*\bsend e-?mail
"""


def _forms(text: str) -> dict[str, list[str]]:
    rows = (line.split(" :: ") for line in text.strip().splitlines())
    return {form: patterns.split(" || ") for form, patterns in rows}


DATA_RULES, ACTOR_RULES = _forms(DATA_FORMS), _forms(ACTOR_FORMS)


def compile_rule(pattern: str) -> tuple[bool, str]:
    """(forbids, regular expression) of a rule (NRM-01)."""
    forbids, p = pattern.startswith("!"), pattern.removeprefix("!")
    flag, p = ("", p[1:]) if p.startswith("=") else ("i", p)
    return forbids, f"(?{flag}:{'' if p.startswith('^') else chr(92) + 'b'}{p}{'' if p.endswith('$') else chr(92) + 'b'})"


def fused_rules(kind: str, rules: dict[str, list[str]] | None = None) -> list[tuple[str, str, str]]:
    """(normal form, one expression that must match, one that mustn't or '') (OPT-09); ``rules`` replace the built-in ones."""
    out = []
    for term, patterns in (rules or (DATA_RULES if kind == "DATA" else ACTOR_RULES)).items():
        tests = [compile_rule(p) for p in patterns]
        out.append((term, "|".join(r for no, r in tests if not no), "|".join(r for no, r in tests if no)))
    return out


def sql_rules(kind: str) -> list[tuple[str, str, str]]:
    """The same for a SQL statement, quotes doubled."""
    return [tuple(x.replace("'", "''") for x in r) for r in fused_rules(kind)]


def normal_forms(c: Column, kind: str, rules: dict[str, list[str]] | None = None) -> Column:
    """Array of all normal forms that a phrase matches, in the order of the rules (NRM-02)."""
    hits = [F.when(c.rlike(yes) & (~c.rlike(no) if no else F.lit(True)), F.lit(term)) for term, yes, no in fused_rules(kind, rules)]
    return F.array_compact(F.array(*hits))


def normalize(df: DataFrame, phrase: str, kind: str, rules: dict[str, list[str]] | None = None) -> DataFrame:
    """(phrase, term) for every normal form; phrases that match none give no row."""
    return df.select(phrase, F.explode(normal_forms(F.col(phrase), kind, rules)).alias("term"))


def normal_or_stem(c: Column, kind: str) -> Column:
    """Normal forms, or the phrase itself in lower case; UNSPECIFIED alone becomes UNSPECIFIED_<kind> (BLD-11)."""
    forms = normal_forms(c, kind)
    known = F.filter(forms, lambda x: x != "UNSPECIFIED")
    return F.when(F.size(known) > 0, known).when(F.size(forms) > 0, F.array(F.lit(f"UNSPECIFIED_{kind}"))).otherwise(F.array(F.lower(c)))


def phrase_terms(phrase: Column, lemmas: Column, stem: Column, kind: str, may_fall_back: Column) -> Column:
    """Array of the terms of a phrase, by three passes (NRM-02, NRM-03).

    First all forms that its text or its lemmas match (and neither matches a forbidden pattern); if none,
    those that its stem matches; if none and ``may_fall_back``, the stem itself. A phrase \\0 is a pronoun
    other than I, we or you: UNSPECIFIED.
    """
    text, lem = (F.regexp_replace(c, r"^\p{Punct}+|\p{Punct}+$", "") for c in (phrase, lemmas))
    full, short = [], []
    for term, yes, no in fused_rules(kind):
        free = lambda *cs, no=no: ~F.greatest(*[c.rlike(no) for c in cs]) if no and len(cs) > 1 else ~cs[0].rlike(no) if no else F.lit(True)
        full.append(F.when(free(text, lem) & (text.rlike(yes) | lem.rlike(yes)), F.lit(term)))
        short.append(F.when(free(stem) & stem.rlike(yes), F.lit(term)))
    full, short = F.array_compact(F.array(*full)), F.array_compact(F.array(*short))
    none = F.array().cast("array<string>")
    return F.when(phrase == "\0", F.array(F.lit("UNSPECIFIED"))).when(F.size(full) > 0, full).when(F.size(short) > 0, short).when(may_fall_back & (stem != ""), F.array(F.lower(stem))).otherwise(none)


WORDS = r"[^\p{L}\p{N}&'._-]+"


def match_entities(names: DataFrame, entities: DataFrame) -> DataFrame:
    """(name, entity): the companies that a name speaks of (NRM-04..06).

    names: name; entities: entity, aliases, domains, ngrams MAP<n-gram, is it out of the vocabulary>. A name
    that is a domain is its entity's, and nothing else counts. Otherwise each n-gram of its words counts that
    names an entity: one out of the vocabulary in any case, another one only if it stands, written as in the
    name, in an alias of that entity. Of overlapping n-grams the longest counts, and of equally long ones the
    first. An n-gram or domain of several entities is the least one's.
    """
    n = names.select("name").where("trim(name) <> ''").distinct()
    domains = entities.select(F.explode("domains").alias("d"), "entity").groupBy(F.lower(F.trim("d")).alias("key")).agg(F.min("entity").alias("entity"))
    by_domain = n.select("name", F.lower(F.trim("name")).alias("key")).join(domains, "key").select("name", "entity")
    grams = entities.select("entity", F.explode("ngrams").alias("key", "oov")).where("trim(key) <> ''")
    grams = grams.groupBy(F.lower(F.trim("key")).alias("key")).agg(F.min(F.struct("entity", "oov")).alias("r")).select("key", "r.entity", F.coalesce("r.oov", F.lit(False)).alias("oov"))
    words = F.filter(F.split("name", WORDS), lambda w: w != "")
    size = F.size("w")
    rest = n.join(by_domain.select("name"), "name", "left_anti").select("name", words.alias("w"))
    runs = rest.where("size(w) > 0").select("name", F.explode(F.flatten(F.transform(F.sequence(F.lit(1), size), lambda i: F.transform(F.sequence(i, size), lambda j: F.struct(i.alias("i"), j.alias("j"), F.array_join(F.slice(F.col("w"), i, j - i + 1), " ").alias("g")))))).alias("r"))
    hits = runs.select("name", "r.i", "r.j", F.col("r.g").alias("surface"), F.lower("r.g").alias("key")).join(grams, "key")
    others = hits.select("name", F.col("i").alias("oi"), F.col("j").alias("oj")).distinct()
    longer = ((F.col("oj") - F.col("oi")) > (F.col("j") - F.col("i"))) | (((F.col("oj") - F.col("oi")) == (F.col("j") - F.col("i"))) & (F.col("oi") < F.col("i")))
    beaten = hits.select("name", "i", "j").join(others, "name").where((F.col("oi") <= F.col("j")) & (F.col("oj") >= F.col("i")) & longer).select("name", "i", "j").distinct()
    hits = hits.join(beaten, ["name", "i", "j"], "left_anti")
    spelled = F.concat(F.lit(" "), F.array_join(F.filter(F.split("alias", WORDS), lambda w: w != ""), " "), F.lit(" "))
    aliases = entities.select("entity", F.explode("aliases").alias("alias")).select("entity", spelled.alias("alias")).distinct()
    common = hits.where("not oov").join(aliases, "entity").where(F.contains(F.col("alias"), F.concat(F.lit(" "), "surface", F.lit(" ")))).select("name", "entity")
    return by_domain.unionByName(hits.where("oov").select("name", "entity")).unionByName(common).distinct()


# Words of purposes, by class.
PURPOSE_WORDS = {
    "advertising": r"\b(advert|ads?\b|market|campaign|promot|offers?\b)",
    "analytics": r"\b(analy|statistic|measure|research|improve|learn|plan)",
    "legal": r"\b(legal|law|comply|duty|duties|dispute|court)",
    "security": r"\b(secur|fraud|safe|protect|abuse|detect)",
    "services": r"\b(service|deliver|provide|support|request|order|refund|account|personali|fault|repair)",
}


def classify_purpose(c: Column) -> Column:
    """Labels of a purpose by its words; any other model of text to labels plugs in here (NRM-07)."""
    t = F.lower(c)
    return F.array_compact(F.array(*[F.when(t.rlike(p), F.lit(k)) for k, p in PURPOSE_WORDS.items()]))
