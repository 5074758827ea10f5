"""URL rules that follow redirects: what a rule says of one address holds for its aliases."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialize
from .components import components

_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``text`` is a host, or a host and the start of a path; it fits the host and its subdomains."""

    action: str
    text: str

    @property
    def parts(self) -> tuple[str, str]:
        host, slash, path = self.text.partition("/")
        return host.lower(), slash + path


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path; both empty if there is no ``://`` or no url."""
    after = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    host = F.translate(F.regexp_extract(after, "^([^/?#]*)", 1), _CAPITALS, _SMALL)
    path = F.regexp_extract(after, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def match(rules: list[Rule], host: Column, path: Column) -> Column:
    """The text of the longest rule that fits, else null; of rules with one text an allow comes first."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        h, p = r.parts
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.lit(r.text)).otherwise(out)
    return out


def action(rules: list[Rule], text: Column) -> Column:
    actions: dict[str, str] = {}
    for r in rules:
        if actions.get(r.text) != "allow":
            actions[r.text] = r.action
    out = F.lit(None).cast("string")
    for t, a in actions.items():
        out = F.when(text == t, F.lit(a)).otherwise(out)
    return out


#: Host labels and query parameters that choose a view of a page or tell where its reader came from.
VIEWS = ("www.", "m.")
TRACKING = ("utm_", "ref=", "fbclid=", "gclid=")
#: What a browser doesn't take for markup of the page.
HIDDEN = "(?is)<!--.*?-->|<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>"
TAGS = "(?i)<(?:link|meta)\\b[^>]*>"
CANONICAL = "(?i)\\brel\\s*=\\s*(?:\"(?:[^\"]*\\s)?canonical(?:\\s[^\"]*)?\"|'(?:[^']*\\s)?canonical(?:\\s[^']*)?'|canonical[\\s/>])"
REFRESH = "(?i)\\bhttp-equiv\\s*=\\s*[\"']?refresh\\b"
HREF, TO, BASE = ("(?i)%s\\s*=\\s*[\"']?\\s*([^\"'\\s>]+)" % x for x in ("\\bhref", "\\burl", "<base\\b[^>]*\\bhref"))
#: How html writes the sign & in an attribute.
AMPERSAND = "&(?:amp|#38|#[xX]26);"
ORIGIN, FOLDER, PAGE = "^([^:/?#]+://[^/?#]*)", "^([^:/?#]+://[^/?#]*(?:/[^?#]*/|/)?)", "^([^?#]*)"
SCHEME = "^[A-Za-z][A-Za-z0-9+.-]*:"


def address(url: Column) -> Column:
    """What an address's usual redirects end at: no scheme, host label of VIEWS, fragment, parameters of TRACKING, ``.html``, index page or
    closing slash. Null without ``://``.
    """
    host, path = split_url(url)
    query = F.regexp_extract(url, "^[^?#]*\\?([^#]*)", 1)
    told = lambda x: reduce(or_, [x.startswith(t) for t in TRACKING], x == "")
    kept = F.array_join(F.filter(F.split(query, "&"), lambda x: ~told(x)), "&")
    plain = F.regexp_replace(F.regexp_replace(path, "(?:/index)?\\.html?$", ""), "/+$", "")
    base = F.concat(F.regexp_replace(host, f"^(?:{'|'.join(v[:-1] for v in VIEWS)})\\.", ""), plain)
    return F.when(F.instr(url, "://") > 0, F.concat(base, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit(""))))


def resolved(base: Column, to: Column) -> Column:
    """The address that a reference leads to from a page of address ``base``, without dot segments; null where that is no other page."""
    first = lambda x, p: F.regexp_extract(x, p, 1)
    folder = first(base, FOLDER)
    folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    whole = (
        F.when(to.rlike(SCHEME), F.when(to.contains("://"), to))
        .when((to == "") | to.startswith("#"), F.lit(None))
        .when(to.startswith("//"), F.concat(first(base, "^([^:]*:)"), to))
        .when(to.startswith("/"), F.concat(first(base, ORIGIN), to))
        .when(to.startswith("?"), F.concat(first(base, PAGE), to))
        .otherwise(F.concat(folder, to))
    )
    step = lambda kept, x: F.when(x == ".", kept).when(x == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(1)))).otherwise(F.concat(kept, F.array(x)))
    path = F.aggregate(F.split(F.regexp_extract(whole, "^[^:/?#]+://[^/?#]*([^?#]*)", 1), "/"), F.array().cast("array<string>"), step)
    return F.concat(first(whole, ORIGIN), F.array_join(path, "/"), F.regexp_extract(whole, "^[^?#]*(.*)$", 1))


def declared(url: Column, html: Column) -> Column:
    """The addresses that a page names as its canonical one or sends its reader to, as an array of urls.

    Comments, scripts and styles are no markup; ``<base>``, dot segments and ``&amp;`` are read as browsers do.
    """
    shown = F.regexp_replace(html, HIDDEN, "")
    tags = F.regexp_extract_all(shown, F.lit(TAGS), 0)
    canonical, refresh = F.filter(tags, lambda t: t.rlike(CANONICAL)), F.filter(tags, lambda t: t.rlike(REFRESH))
    to = F.concat(F.transform(canonical, lambda t: F.regexp_extract(t, HREF, 1)), F.transform(refresh, lambda t: F.regexp_extract(t, TO, 1)))
    named = F.regexp_extract(shown, BASE, 1)
    base = F.coalesce(F.when(named != "", resolved(url, F.regexp_replace(named, AMPERSAND, "&"))), url)
    return F.filter(F.transform(to, lambda x: resolved(base, F.regexp_replace(x, AMPERSAND, "&"))), lambda x: x.isNotNull())


def judge(
    pages: DataFrame, rules: list[Rule], redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url",
    html_col: str | None = "html",
) -> DataFrame:
    """One row for each row of pages: (id, host, path, rule, verdict, alias_of).

    A page that a rule fits has the rule's verdict. Others take part in their class of aliases: pages of one
    address() and all addresses that redirects (columns from_url, to_url), canonical links and refreshes in
    the html connect. If a rule allows any address of the class the verdict is allow, else block if
    a rule blocks one, else allow. ``alias_of`` is the class's least address. A url that is null or
    without ``://`` has an empty host and path, no aliases and the verdict allow; null html and ids are
    fine; repeated rows are judged each; empty pages give no rows; other columns are not read.

    Links and components stay distributed. Rules are a list that the caller holds, so the plan has them as expressions.
    """
    host, path = split_url(F.col("url"))
    wanted = [F.col(id_col).alias("id"), F.col(url_col).alias("url")]
    rows = pages.select(*wanted, declared(F.col(url_col), F.col(html_col)).alias("to") if html_col else F.array().cast("array<string>").alias("to"))
    rows = rows.select("id", "url", "to", host.alias("host"), path.alias("path"), address(F.col("url")).alias("address"))
    rows = materialize(rows.withColumn("rule", match(rules, F.col("host"), F.col("path"))), "pages")

    pairs = rows.select("url", F.explode("to").alias("to"))
    if redirects is not None:
        pairs = pairs.unionByName(redirects.select(F.col("from_url").alias("url"), F.col("to_url").alias("to")))
    edges = materialize(pairs.select(address(F.col("url")).alias("a"), address(F.col("to")).alias("b"), F.col("url"), F.col("to")), "edges")
    member = components(edges)

    def stance(urls: DataFrame) -> DataFrame:
        h, p = split_url(F.col("u"))
        return urls.select("address", action(rules, match(rules, h, p)).alias("action"))

    said = stance(rows.select("address", F.col("url").alias("u")))
    said = said.unionByName(stance(edges.select(F.col("a").alias("address"), F.col("url").alias("u")))).unionByName(stance(edges.select(F.col("b").alias("address"), F.col("to").alias("u"))))
    # one row for each address and action before anything meets, so a large class is a few rows
    said = said.filter(F.col("address").isNotNull() & F.col("action").isNotNull()).distinct()
    member = member.select(F.col("node").alias("address"), "component")
    decided = said.join(member, "address", "left").groupBy(F.coalesce("component", "address").alias("alias_of"))
    decided = decided.agg(F.min("action").alias("class_action"))  # allow comes before block
    known = rows.filter("address IS NOT NULL").join(member, "address", "left").withColumn("alias_of", F.coalesce("component", "address")).join(decided, "alias_of", "left")
    # rows without an address meet nothing, and so need no task of their own
    alone = rows.filter("address IS NULL").withColumns({"alias_of": F.lit(None).cast("string"), "class_action": F.lit(None).cast("string")})
    out = known.select("id", "host", "path", "rule", "alias_of", "class_action").unionByName(alone.select("id", "host", "path", "rule", "alias_of", "class_action"))
    verdict = F.coalesce(action(rules, F.col("rule")), F.col("class_action"), F.lit("allow"))
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "alias_of")
