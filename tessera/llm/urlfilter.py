"""URL filtering with pattern rules indexed by their rarest literal token, in DataFrame operations only.

Every rule is a regular expression over the URL without its scheme. tokens_of() derives from the expression
the literal tokens (runs of a-z and 0-9) that any URL it matches must contain whole: runs of letters whose
neighbours in the expression can only be other characters or an end. How often each of these tokens occurs is
counted over the whole table, and each rule is filed under its rarest one. A URL's own tokens fetch the
candidate rules, and only those run their expressions.

The index is a literal in the plan up to LITERAL_RULES rules, which costs no shuffle; beyond, the tokens
of the URLs are joined with the index, which is broadcast up to BROADCAST_RULES rules.

Defined results: a null URL, or one without "://", has an empty host and path and fits no rule; repeated
rows each get their own result; an empty table gives an empty result; rules without a token are tried on
every URL, by no join; a host rule fits its host and all subdomains; of extra columns those whose names clash
with the new ones, in whatever case, give way.
"""

from __future__ import annotations

import json
import re
from re import _parser  # the standard library's own reader of expressions
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LITERAL_RULES = 2000
BROADCAST_RULES = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """`tokens` must occur whole in the lower-cased URL; among matching rules the least `tier` wins, then the
    largest `weight`, then the first listed."""

    name: str
    action: str
    regex: str
    tokens: tuple[str, ...]
    tier: int
    weight: int


def _is_token(code: int) -> bool:
    return chr(code).isascii() and chr(code).isalnum()


def _holds_token(op, value) -> bool:
    """Whether a class of an expression has a letter or digit."""
    if op is _parser.NOT_LITERAL or op is _parser.ANY:
        return True
    negated, codes = False, set()
    for kind, v in value:
        if kind is _parser.NEGATE:
            negated = True
        elif kind is _parser.LITERAL:
            codes.add(v)
        elif kind is _parser.RANGE:
            codes |= set(range(v[0], min(v[1], 127) + 1))
        else:
            return True
    return any((c in codes) != negated for c in range(128) if _is_token(c))


def _closed(items: list) -> bool | None:
    """Whether the first of these items surely begins with no letter or digit, or is an end of the URL; None
    if they may all be empty. (Behind a token they stand in their order, before it in reverse.)"""
    for op, value in items:
        if op is _parser.AT:
            return value in (_parser.AT_BEGINNING, _parser.AT_END)
        if op is _parser.LITERAL:
            return not _is_token(value)
        if op in (_parser.IN, _parser.NOT_LITERAL, _parser.ANY):
            return not _holds_token(op, value)
        if op in (_parser.MAX_REPEAT, _parser.MIN_REPEAT):
            least, _, inner = value
            found = _closed(list(inner))
            if found is False or (found and least):
                return found
        elif op is _parser.BRANCH:
            found = [_closed(list(x)) for x in value[1]]
            if not all(f or f is None for f in found):
                return False
            if None not in found:
                return True
        else:
            return False
    return None


def _reverse(items) -> list:
    """The same items as they are met from their end."""
    out = []
    for op, value in reversed(list(items)):
        if op in (_parser.MAX_REPEAT, _parser.MIN_REPEAT):
            value = (value[0], value[1], _reverse(value[2]))
        elif op is _parser.BRANCH:
            value = (value[0], [_reverse(x) for x in value[1]])
        out.append((op, value))
    return out


def _flat(parsed) -> list:
    """The items of an expression, groups that are not repeated opened up."""
    out = []
    for op, value in parsed:
        if op is _parser.SUBPATTERN:
            out += _flat(value[3])
        elif op in (_parser.MAX_REPEAT, _parser.MIN_REPEAT):
            out.append((op, (value[0], value[1], _flat(value[2]))))
        elif op is _parser.BRANCH:
            out.append((op, (value[0], [_flat(x) for x in value[1]])))
        else:
            out.append((op, value))
    return out


def tokens_of(regex: str) -> tuple[str, ...]:
    """The tokens that every URL has whole, in lower case, if the expression matches it."""
    items = _flat(_parser.parse(regex))
    out, i = [], 0
    while i < len(items):
        j = i
        while j < len(items) and items[j][0] is _parser.LITERAL and _is_token(items[j][1]):
            j += 1
        if j > i:
            if _closed(_reverse(items[:i])) and _closed(items[j:]):
                out.append("".join(chr(v) for _, v in items[i:j]).lower())
            i = j
        else:
            i += 1
    return tuple(dict.fromkeys(out))


def host_rule(action: str, rule: str) -> Rule:
    """A rule `host/path` for the host and its subdomains and all paths that start with its path."""
    host, _, path = rule.partition("/")
    regex = rf"^(?:[^/?#]*\.)?{re.escape(host)}/{re.escape(path)}"
    return Rule(rule, action, regex, tokens_of(regex), 0, len(rule))


def pattern_rule(action: str, regex: str) -> Rule:
    return Rule(regex, action, regex, tokens_of(regex), 1, len(regex))


def _blocked(form: str, words: str) -> tuple[Rule, ...]:
    return tuple(pattern_rule("block", form.format(re.escape(w))) for w in words.split())


#: The method's own rules, for URLs that no host rule fits (fixed values). Addresses of tracking, print and
#: session variants of pages; parts of sites that hold no text; files that are none; gambling and adult hosts;
#: hosts that serve advertisements.
PATTERNS = (
    pattern_rule("block", r"[?&]utm_source="),
    pattern_rule("block", r"^m\.[^/?#]+/[a-z]+/[0-9]+/?$"),
    pattern_rule("block", r"/[0-9]+\.html$"),
    pattern_rule("allow", r"^www\.[^/?#]+/"),
    pattern_rule("block", r"[?&]page=[0-9]+&ref="),
    *_blocked(r"[?&]{}=", "utm_medium utm_campaign utm_term utm_content gclid fbclid msclkid mc_cid mc_eid igshid yclid dclid sessionid phpsessid sid jsessionid replytocom print share sort orderby filter add-to-cart affiliate aff_id returnurl"),
    *_blocked(r"^[^/?#]+/(?:[^?#]*/)?{}(?:[/?#]|$)", "login logout signin signup register account password checkout cart basket wishlist wp-admin wp-json xmlrpc cgi-bin admin search feed rss atom print calendar captcha unsubscribe subscribe privacy-policy cookie-policy terms-of-service sitemap tag tags archive attachment trackback embed amp"),
    *_blocked(r"\.{}(?:[?#]|$)", "jpg jpeg png gif webp svg ico bmp css js json xml zip gz rar exe dmg apk iso mp3 mp4 avi mov wmv flv wav ttf woff woff2 swf"),
    *_blocked(r"^(?:[^/?#]*[.-])?{}(?:[.-][^/?#]*)?(?:[/?#:]|$)", "bets casino casinos poker slots jackpot roulette lottery porn xxx escort escorts viagra cialis payday warez torrent torrents"),
    *_blocked(r"^{}\.[^/?#]+", "ads adserver track tracker tracking pixel click clicks banner banners stats analytics metrics counter doubleclick popads"),
    *_blocked(r"^(?:[^/?#]*\.)?{}(?:[/?#:]|$)", "doubleclick.net googlesyndication.com googleadservices.com google-analytics.com adnxs.com criteo.com taboola.com outbrain.com scorecardresearch.com quantserve.com"),
)


def parts(url: Column) -> tuple[Column, Column, Column]:
    """Host (A-Z lower-cased), path, and the rest from ? or # on."""
    at = F.instr(url, "://")
    after = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    after = F.coalesce(after, F.lit(""))
    host = F.regexp_extract(after, r"^[^/?#]*", 0)
    tail = F.substring(after, F.length(host) + 1, F.length(after))
    path = F.regexp_extract(tail, r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path, F.substring(tail, F.length(path) + 1, F.length(tail))


def _tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.translate(text, UPPER, LOWER), "[^a-z0-9]+"), lambda t: t != ""))


def rarest(urls: DataFrame, rules: tuple[Rule, ...]) -> dict[str, list[int]]:
    """Token -> numbers of the rules filed under it; "" for rules without a token. `urls` has `_tokens`.

    At most one count for each token of the rules comes to the driver, which holds the rules anyway.
    """
    wanted = sorted({t for r in rules for t in r.tokens})
    counts: dict[str, int] = {}
    if wanted:
        mine = F.from_json(F.lit(json.dumps(wanted)), "array<string>")
        found = urls.select(F.explode(F.array_intersect("_tokens", mine)).alias("t")).groupBy("t").count()
        counts = {r["t"]: r["count"] for r in found.collect()}
    index: dict[str, list[int]] = {}
    for i, r in enumerate(rules):
        token = min(r.tokens, key=lambda t: (counts.get(t, 0), t)) if r.tokens else ""
        index.setdefault(token, []).append(i)
    return index


def classify(pages: DataFrame, rules: tuple[Rule, ...], url_col: str = "url", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (default: all), host, path, rule (the name of the winning rule of tier 0, else
    null) and verdict (the winning rule's action, else "allow")."""
    kept = [c for c in (pages.columns if keep is None else keep) if c.lower() not in ("host", "path", "rule", "verdict")]
    host, path, rest = parts(F.col(f"`{url_col}`"))
    df = pages.select(*[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(kept)], host.alias("host"), path.alias("path"), rest.alias("_rest"))
    df = df.withColumn("_text", F.concat("host", "path", "_rest")).withColumn("_tokens", _tokens(F.col("_text")))
    index = rarest(df, rules)
    if len(rules) <= LITERAL_RULES:
        df = df.withColumn("_hits", _literal(index, rules))
    else:
        df = _joined(df, index, rules)
    # the order of preference is the rules' own order after sorting
    names = F.from_json(F.lit(json.dumps([r.name if r.tier == 0 else None for r in rules])), "array<string>")
    actions = F.from_json(F.lit(json.dumps([r.action for r in rules])), "array<string>")
    place = {i: p for p, i in enumerate(sorted(range(len(rules)), key=lambda i: (rules[i].tier, -rules[i].weight, i)))}
    order = F.from_json(F.lit(json.dumps([place[i] for i in range(len(rules))])), "array<int>")
    ranked = F.array_min(F.transform("_hits", lambda i: F.struct(F.get(order, i).alias("o"), i.alias("i"))))["i"]
    df = df.withColumn("_rule", ranked)
    ranked = F.col("_rule")
    return df.select(
        *[F.col(f"_k{i}").alias(c) for i, c in enumerate(kept)],
        "host",
        "path",
        F.get(names, ranked).alias("rule"),
        F.coalesce(F.get(actions, ranked), F.lit("allow")).alias("verdict"),
    )


def _literal(index: dict[str, list[int]], rules: tuple[Rule, ...]) -> Column:
    """Numbers of the rules that match `_text`, by way of `_tokens`."""
    table = F.from_json(F.lit(json.dumps(index)), "map<string,array<int>>")
    regexes = F.from_json(F.lit(json.dumps([r.regex for r in rules])), "array<string>")
    fetched = F.filter(F.transform("_tokens", lambda t: F.element_at(table, t)), lambda a: a.isNotNull())
    found = F.concat(F.flatten(fetched), _numbers(index.get("", [])))
    return F.filter(found, lambda i: (F.col("_text") != "") & F.regexp_like(F.col("_text"), F.get(regexes, i)))


def _numbers(of: list[int]) -> Column:
    return F.from_json(F.lit(json.dumps(of)), "array<int>")


def _joined(df: DataFrame, index: dict[str, list[int]], rules: tuple[Rule, ...]) -> DataFrame:
    """The same by a join on tokens. Each distinct URL is matched once, so a URL that many rows share costs
    no more than another; Spark divides tokens that many URLs share (skewed join)."""
    spark = df.sparkSession
    rows = [(t, i, rules[i].regex) for t, numbers in index.items() if t for i in numbers]
    table = spark.createDataFrame(rows, "t string, i int, regex string")
    if len(rows) <= BROADCAST_RULES:
        table = F.broadcast(table)
    texts = df.where("_text <> ''").select("_text", "_tokens").dropDuplicates(["_text"])
    fetched = texts.select("_text", F.explode("_tokens").alias("t")).join(table, "t")
    hits = fetched.where(F.regexp_like("_text", F.col("regex"))).groupBy("_text").agg(F.collect_set("i").alias("_hits"))
    free = index.get("", [])
    regexes = F.from_json(F.lit(json.dumps([rules[i].regex for i in free])), "array<string>")
    every = F.filter(F.transform(_numbers(free), lambda i, k: F.when((F.col("_text") != "") & F.regexp_like(F.col("_text"), F.get(regexes, k)), i)), lambda i: i.isNotNull())
    return df.join(hits, "_text", "left").withColumn("_hits", F.concat(F.coalesce("_hits", F.array().cast("array<int>")), every))
