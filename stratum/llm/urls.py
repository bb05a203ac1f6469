"""URL filter: pattern rules indexed by their rarest literal token.

Host and path rules and pattern rules stand in one table. A URL's tokens are the runs of letters and digits
of its host and path. The literal tokens of a rule, which any URL it fits must hold whole, are read from its pattern (literals()), and it
is filed under the rarest of them, as counted over all URLs. URLs fetch the rules filed under their own tokens by a join on the
token, and only those run their regular expressions; rules without a literal token run on every URL. Each distinct host and
path is judged once. The longest fitting host and path rule decides; where none fits, any fitting pattern rule blocks, else
the URL is allowed.

Cases: a null URL or one without ``://`` has an empty host and path and is allowed; a null id stays; repeated
rows each give a row; an empty table gives an empty result; other columns are not looked at; bytes that are not UTF-8 count as U+FFFD.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from re import _parser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, sound, table

TOKEN = re.compile(r"[a-z0-9]+")
#: Characters of rules up to which their table goes to every task; larger tables are joined by a shuffle, whose hot tokens Spark can split.
SENT = 8_000_000


@dataclass(frozen=True)
class Rule:
    """A host and path rule (path with its leading slash) or, with a pattern, a rule on the text ``host + path``."""

    action: str
    host: str = ""
    path: str = ""
    pattern: str = ""

    @property
    def name(self) -> str:
        return self.host + self.path

    def regex(self) -> str:
        return self.pattern or rf"(?:[^/]*\.)?{re.escape(self.host)}{re.escape(self.path)}"


# The rules on host and path.
SITE_RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)
#: Pattern rules for the URLs that no site rule fits.
PATTERN_RULES = tuple(
    Rule("block", pattern=p)
    for p in (
        r"[^/]*/(?:[^/]*/)*(?:wp-login|wp-admin)(?:\.php)?(?:/|$)",
        r"(?:[^/]*\.)?ads?[0-9]*\.[^/]+/",
        r"[^/]*/(?:[^/]*/)*casino(?:[-_/.]|$)",
        r"[^/]*/(?:[^/]*/)*cart/checkout(?:/|$)",
        r"[^/]*/(?:[^/]*/)*tag/[^/]+/page/[0-9]+(?:/|$)",
        r"[^/]*/(?:[^/]*/)*login(?:/|$)",
        r"(?:[^/]*\.)?tracker\.[^/]+/",
        r"(?:[^/]*\.)?spam-[^./]*\.[^/]+/",
    )
)


@dataclass(frozen=True)
class Piece:
    """A part of a pattern that every match holds: a letter as written, or what may be several things."""

    letter: str = ""
    starts: bool = False  # may begin, or end, with a character of a token
    ends: bool = False
    empty: bool = False
    edge: bool = False  # nothing of the text lies beyond


def _in_token(op: str, value) -> bool:
    """Whether a class of characters, or one of them, can be in a token."""
    if op == "LITERAL":
        return chr(value).isascii() and chr(value).isalnum()
    if op == "RANGE":
        return any(value[0] <= ord(c) <= value[1] for c in "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
    if op == "CATEGORY":
        return str(value) not in ("CATEGORY_SPACE", "CATEGORY_NOT_WORD")
    if op == "IN":
        kinds = [(str(o), v) for o, v in value]
        if kinds[0][0] == "NEGATE":
            return any(not any(_holds(o, v, ord(c)) for o, v in kinds[1:]) for c in "09azAZmq")
        return any(_in_token(o, v) for o, v in kinds)
    return True


def _holds(op: str, value, c: int) -> bool:
    if op == "LITERAL":
        return value == c
    if op == "RANGE":
        return value[0] <= c <= value[1]
    return bool(re.match({"CATEGORY_DIGIT": r"\d", "CATEGORY_WORD": r"\w", "CATEGORY_SPACE": r"\s", "CATEGORY_NOT_DIGIT": r"\D", "CATEGORY_NOT_WORD": r"\W"}.get(str(value), r"\S"), chr(c), re.ASCII))


def _pieces(parsed) -> list[Piece]:
    out: list[Piece] = []
    for op, value in parsed:
        name = str(op)
        if name == "LITERAL":
            out.append(Piece(chr(value), _in_token(name, value), _in_token(name, value)))
        elif name == "SUBPATTERN":
            out += _pieces(value[3])
        elif name == "ATOMIC_GROUP":
            out += _pieces(value)
        elif name == "BRANCH":
            ways = [_whole(_pieces(w)) for w in value[1]]
            out.append(Piece("", any(w.starts for w in ways), any(w.ends for w in ways), any(w.empty for w in ways)))
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            one = _whole(_pieces(value[2]))
            out.append(Piece("", one.starts, one.ends, one.empty or value[0] == 0))
        elif name == "AT":
            if str(value) not in ("AT_BOUNDARY", "AT_NON_BOUNDARY"):
                out.append(Piece(edge=True))
        elif name not in ("ASSERT", "ASSERT_NOT"):  # these take no room
            token = _in_token(name, value) if name == "IN" else True
            out.append(Piece("", token, token, name in ("GROUPREF", "GROUPREF_EXISTS")))
    return out


def _whole(pieces: list[Piece]) -> Piece:
    """A sequence as one piece."""
    return Piece("", _next(pieces, 0, 1, False), _next(pieces, len(pieces) - 1, -1, False), all(p.empty for p in pieces))


def _next(pieces: list[Piece], at: int, way: int, beyond: bool) -> bool:
    """Whether a character of a token may stand first from a place on, one way; beyond: if the sequence is over there."""
    while 0 <= at < len(pieces):
        p = pieces[at]
        if p.edge:
            return False
        if p.starts if way > 0 else p.ends:
            return True
        if not p.empty:
            return False
        at += way
    return beyond


@lru_cache(maxsize=65536)
def literals(pattern: str) -> tuple[str, ...]:
    """The tokens that every text the pattern fits from its beginning on holds whole, in small letters."""
    pieces = _pieces(_parser.parse(pattern, re.ASCII))
    out: list[str] = []
    at = 0
    while at < len(pieces):
        end = at
        while end < len(pieces) and pieces[end].letter:
            end += 1
        run = "".join(p.letter for p in pieces[at:end])
        for m in TOKEN.finditer(run.lower() if run.isascii() else ""):
            opens = m.start() > 0 or not _next(pieces, at - 1, -1, False)
            closes = m.end() < len(run) or not _next(pieces, end, 1, True)
            if opens and closes:
                out.append(m[0])
        at = max(end, at + 1)
    return tuple(dict.fromkeys(out))


def split_columns(url):
    """(host, path) of a URL column; both empty if it is null or has no ``://``."""
    rest = F.regexp_extract(sound(url), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def sent(rules: DataFrame, everything: Sequence[Rule]) -> DataFrame:
    """A table of at most a row for each rule and token, marked to go to every task if the rules are small, which is known here."""
    return F.broadcast(rules) if sum(64 + 3 * len(r.regex()) for r in everything) <= SENT else rules


def filed(urls: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(token, n) of the rules with literal tokens: each under that of its own which the fewest of the urls (host, path, tokens,
    times) hold. Only tokens that rules have are counted."""
    own = urls.sparkSession.createDataFrame([(t, n) for n, r in enumerate(rules) for t in literals(r.regex())], "token string, n int")
    counts = urls.select(F.explode("tokens").alias("t"), "times").join(sent(own.select("token").distinct(), rules), F.col("t") == F.col("token")).groupBy("t").agg(F.sum("times").alias("urls"))
    met = own.join(counts, F.col("token") == F.col("t"), "left")
    return met.groupBy("n").agg(F.min(F.struct(F.coalesce("urls", F.lit(0)).alias("urls"), "token")).alias("best")).select(F.col("best.token").alias("token"), "n")


@lru_cache(maxsize=65536)
def _compiled(regex: str) -> re.Pattern:
    return re.compile(regex, re.ASCII)


#: A rule as it travels: its number, whether it is a pattern, its action, its name or pattern, its regular expression.
_RULE = "struct<n:int,general:boolean,action:string,name:string,regex:string>"


def decide(target: str, rules: list[dict], default: str) -> tuple[str | None, str, str | None]:
    """(rule, verdict, pattern) of a host and path."""
    fit = [r for r in rules if _compiled(r["regex"]).match(target)]
    named = [r for r in fit if not r["general"]]
    if named:
        best = min(named, key=lambda r: (-len(r["name"]), r["n"]))
        return best["name"], best["action"], None
    blocking = min((r["n"], r["name"]) for r in fit if r["action"] == "block") if any(r["action"] == "block" for r in fit) else None
    return (None, "block", blocking[1]) if blocking else (None, default, None)


def url_filter(pages: DataFrame, rules: Sequence[Rule] = SITE_RULES, patterns: Sequence[Rule] = PATTERN_RULES, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict, pattern) of every row; rule and pattern are null where none decided."""
    host, path = split_columns(F.col(url_col))
    pages = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    tokens = F.array_distinct(F.expr("regexp_extract_all(lower(concat(host, path)), '[a-z0-9]+', 0)"))
    urls = cut(pages.groupBy("host", "path").agg(F.count("*").alias("times")).withColumn("tokens", tokens))
    everything = [*rules, *patterns]
    rows = [(n, bool(r.pattern), r.action, r.pattern or r.name, r.regex()) for n, r in enumerate(everything)]
    known = urls.sparkSession.createDataFrame(rows, _RULE)
    told = filed(urls, everything).join(known.withColumnRenamed("n", "k"), F.col("n") == F.col("k")).select("token", F.struct("n", "general", "action", "name", "regex").alias("r"))
    always = [dict(zip(("n", "general", "action", "name", "regex"), r, strict=True)) for r in rows if not literals(r[4])]
    near = urls.select("host", "path", F.explode("tokens").alias("t")).join(sent(told, everything), F.col("t") == F.col("token"))
    near = near.groupBy(F.col("host").alias("n_host"), F.col("path").alias("n_path")).agg(F.collect_list("r").alias("near"))
    tried = urls.join(near, (F.col("host") == F.col("n_host")) & (F.col("path") == F.col("n_path")), "left").select("host", "path", "near")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            said = [decide(h + p, [*always, *(r or [])], default) for h, p, r in zip(hosts, paths, batch.column(2).to_pylist(), strict=True)]
            out = [pa.array([s[j] for s in said], pa.string()) for j in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *out], names=["j_host", "j_path", "rule", "verdict", "pattern"])

    judged = cut(tried.mapInArrow(each, "j_host string, j_path string, rule string, verdict string, pattern string"))
    return pages.join(judged, (F.col("host") == F.col("j_host")) & (F.col("path") == F.col("j_path"))).select("page_id", "host", "path", "rule", "verdict", "pattern")


def op6_url_filter(spark, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"))


OP6_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), s AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM u
), rules(action, rhost, rpath) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), patterns(n, p) AS (
  VALUES (0, '[^/]*/(?:[^/]*/)*(?:wp-login|wp-admin)(?:\.php)?(?:/|$)'), (1, '(?:[^/]*\.)?ads?[0-9]*\.[^/]+/'),
         (2, '[^/]*/(?:[^/]*/)*casino(?:[-_/.]|$)'), (3, '[^/]*/(?:[^/]*/)*cart/checkout(?:/|$)'),
         (4, '[^/]*/(?:[^/]*/)*tag/[^/]+/page/[0-9]+(?:/|$)'), (5, '[^/]*/(?:[^/]*/)*login(?:/|$)'), (6, '(?:[^/]*\.)?tracker\.[^/]+/'),
         (7, '(?:[^/]*\.)?spam-[^./]*\.[^/]+/')
), fit AS (
  SELECT DISTINCT host, path, arg_max(rhost || rpath, length(rhost || rpath)) OVER w AS rule, arg_max(action, length(rhost || rpath)) OVER w AS action
  FROM (SELECT DISTINCT host, path FROM s) JOIN rules
    ON (host = rhost OR suffix(host, '.' || rhost)) AND starts_with(path, rpath)
  WINDOW w AS (PARTITION BY host, path)
), pat AS (
  SELECT host, path, arg_min(p, n) AS pattern FROM (SELECT DISTINCT host, path FROM s) JOIN patterns ON regexp_matches(host || path, '^' || p)
  GROUP BY host, path
)
SELECT s.page_id, s.host, s.path, fit.rule, coalesce(fit.action, CASE WHEN pat.pattern IS NULL THEN 'allow' ELSE 'block' END) AS verdict,
       CASE WHEN fit.rule IS NULL THEN pat.pattern END AS pattern
FROM s LEFT JOIN fit ON s.host = fit.host AND s.path = fit.path LEFT JOIN pat ON s.host = pat.host AND s.path = pat.path
"""
