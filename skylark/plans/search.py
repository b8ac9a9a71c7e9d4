"""One search request as a plan: rules, words, filters, order, facets and shape."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce
from urllib.parse import parse_qs

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylark.functions import geo
from skylark.functions.filters import Settings, declared_facets, facet_filters, numeric_filters, optional_score, parse_filter
from skylark.functions.text import attribute_weights, snippet
from skylark.operators import facets, matching, merchandising, ranking
from skylark.plans import query as q
from skylark.sources.postings import Postings

KNOWN = {
    "searchableAttributes", "attributesForFaceting", "customRanking", "attributesToRetrieve", "unretrievableAttributes",
        "attributeForDistinct", "distinct",
    "removeStopWords", "ignorePlurals", "queryLanguages", "queryType", "attributeWeights", "typoTolerance", "minWordSizefor1Typo",
        "minWordSizefor2Typos",
    "allowTyposOnNumericTokens", "disableTypoToleranceOnWords", "disableTypoToleranceOnAttributes", "disablePrefixOnAttributes",
        "optionalWords",
    "removeWordsIfNoResults", "advancedSyntax", "attributesToHighlight", "attributesToSnippet", "highlightPreTag",
        "highlightPostTag", "minProximity",
}


@dataclass
class IndexSettings:
    """The settings of an index; merge() overwrites the keys that are given and names those it does not support."""

    values: dict = field(default_factory=dict)

    def merge(self, given: Mapping) -> list[str]:
        self.values |= {k: v for k, v in given.items() if k in KNOWN}
        return sorted(k for k in given if k not in KNOWN)

    def get(self, key: str, default=None):
        return self.values.get(key, default)


#: Request parameters and the fields that hold them.
PARAMETERS = {
    "query": "query", "filters": "filters", "facetFilters": "facet_filters", "numericFilters": "numeric_filters",
        "optionalFilters": "optional_filters", "facets": "facets",
    "page": "page", "hitsPerPage": "hits_per_page", "offset": "offset", "length": "length", "responseFields": "response_fields",
        "ruleContexts": "context",
    "restrictSearchableAttributes": "restrict_attributes", "aroundLatLng": "around", "aroundRadius": "radius",
        "aroundPrecision": "precision", "insideBoundingBox": "boxes",
    "insidePolygon": "polygons", "getRankingInfo": "ranking_info", "clickAnalytics": "click_analytics", "enableRules": "enable_rules",
}


@dataclass
class SearchRequest:
    query: str = ""
    filters: str | None = None
    facet_filters: Sequence | None = None
    numeric_filters: Sequence | None = None
    optional_filters: Sequence | None = None
    facets: Sequence[str] = ()
    page: int = 0
    hits_per_page: int = 20
    sort: Sequence[str] = ()
    pins: Sequence[tuple[object, int]] = ()
    hidden: Sequence = ()
    filter_promotes: bool = False
    restrict_attributes: Sequence[str] | None = None
    highlight: Sequence[str] = ()
    response_fields: Sequence[str] = ("*",)
    offset: int | None = None
    length: int | None = None
    context: str | None = None
    #: a point (latitude, longitude), metres around it or "all", and the width of distances that count as equal
    around: tuple[float, float] | None = None
    radius: float | str | None = None
    precision: int | Sequence[tuple[int, int]] = 1
    boxes: Sequence[tuple[float, float, float, float]] | None = None
    polygons: Sequence[Sequence[float]] | None = None
    ranking_info: bool = False
    click_analytics: bool = False
    enable_rules: bool = True
    #: settings for this request alone
    overrides: Mapping = field(default_factory=dict)

    @classmethod
    def from_params(cls, text: str) -> SearchRequest:
        """A request from URL-encoded parameters, lists as JSON; unknown ones raise ValueError."""
        got: dict = {"overrides": {}}
        for k, v in parse_qs(text, keep_blank_values=True).items():
            raw = v[-1]
            value = json.loads(raw) if raw[:1] in "[{" or raw in ("true", "false") else raw
            if k in ("page", "hitsPerPage", "offset", "length", "aroundPrecision", "minWordSizefor1Typo", "minWordSizefor2Typos",
                "distinct", "minProximity"):
                value = int(raw)
            if k == "aroundLatLng":
                value = tuple(float(x) for x in raw.split(","))
            elif k == "aroundRadius":
                value = raw if raw == "all" else float(raw)
            elif k == "ruleContexts":
                value = value[0] if isinstance(value, list) else value
            if k in PARAMETERS:
                got[PARAMETERS[k]] = value
            elif k in KNOWN:
                got["overrides"][k] = value
            else:
                raise ValueError(f"unknown parameter: {k}")
        return cls(**got)


@dataclass
class SearchResult:
    hits: DataFrame | None
    total: int
    nb_pages: int
    facets: DataFrame | None
    extra: dict = field(default_factory=dict)
    place: str = "pos"

    def response(self, fields: Sequence[str] = ("*",)) -> dict:
        """The response of one page, restricted to the fields asked for."""
        out = {"nbHits": self.total, "nbPages": self.nb_pages, "exhaustiveNbHits": True, "exhaustiveTypo": True,
            "exhaustive": {"nbHits": True, "typo": True}, **self.extra}
        out["hits"] = [r.asDict(True) for r in self.hits.orderBy(self.place).collect()] if self.hits is not None else []
        if self.facets is not None:
            by: dict[str, dict[str, int]] = {}
            for r in self.facets.collect():
                by.setdefault(r["facet"], {})[r["value"]] = r["count"]
            out |= {"facets": by, "exhaustiveFacetsCount": True}
        return out if "*" in fields else {k: v for k, v in out.items() if k in fields}


@dataclass
class _Asked:
    """A request after its rules, with its words."""

    request: SearchRequest
    words: q.Parsed
    options: q.Options
    atoms: list[q.Atom]
    ways: list[q.Way]
    rules: dict


class Index:
    """Documents with settings, postings, synonyms and rules.

    Postings are derived from the documents unless stored ones are given, which a search reads by folder.
    Rows are carried as one struct, so attributes may have any names. The place of a hit is the column `pos`,
    or `_pos` where the documents have such an attribute."""

    def __init__(
        self, docs: DataFrame, id_col: str, settings: IndexSettings, postings: DataFrame | Postings | None = None,
            synonyms: DataFrame | None = None, rules: DataFrame | None = None, now: int = 0,
    ):
        self.docs, self.id, self.settings = docs, id_col, settings
        self.searchable = list(settings.get("searchableAttributes") or [n for n, t in docs.dtypes if t == "string"])
        post = postings if postings is not None else matching.postings(docs, id_col, self.searchable)
        if synonyms is not None and "placeholder" in synonyms.columns and not isinstance(post, Postings):
            post = matching.place_placeholders(post, synonyms.where("placeholder IS NOT NULL"))
        self.post = post if isinstance(post, Postings) else Postings(post)
        self.synonyms, self.rules, self.now = synonyms, rules, now
        declared = settings.get("attributesForFaceting")
        self.facets = declared_facets(declared) if declared is not None else {}
        arrays = [n for n, t in docs.dtypes if t.startswith("array")]
        self.filter_settings = Settings(set(self.facets) if declared is not None else None, arrays)
        self.place = "_pos" if "pos" in docs.columns else "pos"

    # --- the request

    def _setting(self, r: SearchRequest, key: str, default=None):
        return r.overrides.get(key, self.settings.get(key, default))

    def options(self, r: SearchRequest) -> q.Options:
        get = lambda k, d=None: self._setting(r, k, d)
        languages = list(get("queryLanguages") or ["en"])
        stop = get("removeStopWords") or ()
        plurals = get("ignorePlurals") or False
        return q.Options(
            get("queryType", "prefixLast"), str(get("typoTolerance", "true")).lower(), int(get("minWordSizefor1Typo", 5)), int(
                get("minWordSizefor2Typos", 9)),
            bool(get("allowTyposOnNumericTokens", True)), {w.lower() for w in get("disableTypoToleranceOnWords") or ()}, set(
                get("disableTypoToleranceOnAttributes") or ()),
            set(get("disablePrefixOnAttributes") or ()), languages if stop is True else list(stop), "en" in languages
                if plurals is True else "en" in (plurals or ()),
            {w for x in get("optionalWords") or () for w in x.split()}, bool(get("advancedSyntax", False)),
        )

    def ask(self, r: SearchRequest) -> _Asked:
        """Apply the rules, then expand the words."""
        told: dict = {}
        if self.rules is not None and r.enable_rules:
            asked = self.docs.sparkSession.createDataFrame([(0, r.query, r.context)], "query_id int, text string, context string")
            got = merchandising.apply_rules(asked, self.rules, self.now).first().asDict(True)
            kind = self.docs.schema[self.id].dataType.simpleString()
            ident = (lambda x: int(x)) if kind in ("int", "bigint", "smallint", "tinyint") else str
            pins = [(ident(p["object_id"]), p["position"]) for p in got.get("promote") or [] if p]
            filters = " AND ".join(f"({f})" if n else f for n, f in enumerate(x for x in (got["filters"], r.filters) if x)) or None
            r = replace(
                r, query=got["rewritten"] if got["rewritten"] != r.query.strip() else r.query, filters=filters, pins=[*r.pins, *pins],
                hidden=[*r.hidden, *[ident(h) for h in got.get("hide") or []]], filter_promotes=r.filter_promotes or bool(
                    got.get("filter_promotes")),
            )
            told = {"userData": got["user_data"].split("|") if got["user_data"] else [],
                "appliedRules": got["applied_rules"].split(",") if got["applied_rules"] else []}
        o = self.options(r)
        p = q.parse(r.query, o)
        atoms, ways = q.expand(p, o, self.post, self.synonyms) if p.words else ([], [])
        return _Asked(r, p, o, atoms, ways, told)

    def condition(self, r: SearchRequest) -> Column:
        s = self.filter_settings
        parts = [parse_filter(r.filters, s), facet_filters(r.facet_filters, s), numeric_filters(r.numeric_filters, s)]
        lat, lng = self._point(r) if r.around or r.boxes or r.polygons else (None, None)
        if r.around and r.radius not in (None, "all"):
            parts.append(geo.around(lat, lng, r.around, float(r.radius)))
        if r.boxes:
            parts.append(geo.inside_boxes(lat, lng, r.boxes))
        if r.polygons:
            flat = [list(zip(x[::2], x[1::2], strict=True)) for x in r.polygons]
            parts.append(reduce(lambda a, b: a | b, [geo.inside_polygon(lat, lng, x) for x in flat]))
        return reduce(lambda a, b: a & b, parts)

    def _point(self, r: SearchRequest) -> tuple[Column, Column]:
        return (F.col("_geoloc.lat"), F.col("_geoloc.lng")) if "_geoloc" in self.docs.columns else (F.col("lat"), F.col("lng"))

    # --- what matches

    def _found(self, a: _Asked) -> DataFrame:
        """_id, _doc, criteria and keys of all documents that fit."""
        r = a.request
        custom = [*r.sort, *(self._setting(r, "customRanking") or [])]
        keys = [F.col(f"`{x.rstrip(')').partition('(')[2]}`").alias(f"k{n}") for n, x in enumerate(custom)]
        near = F.lit(None).cast("double")
        if r.around:
            near = geo.distance_m(*self._point(r), r.around)
        optional = optional_score(r.optional_filters, self.filter_settings) if r.optional_filters else F.lit(0)
        group = self._setting(r, "attributeForDistinct")
        more = [F.col(f"`{group}`").alias("k_group")] if group else []
        rows = self.docs.where(self.condition(r)).select(
            F.col(f"`{self.id}`").alias("_id"), F.struct("*").alias("_doc"), optional.alias("filters"), near.alias("distance"), *keys, *more
        )
        if r.around and r.radius is None:
            auto = rows.agg(geo.auto_radius(F.col("distance"))).first()[0]
            rows = rows.where(F.col("distance") <= auto) if auto is not None else rows.where("distance IS NOT NULL")
        if not a.words.words:
            none = {"typos": 0, "words": 0, "attribute": 0, "proximity": 0, "exact": 0}
            return self._syntax(a, rows.select("*", *[F.lit(v).alias(k) for k, v in none.items()], F.lit(0.0).alias("score")))
        weights = attribute_weights(self.searchable, self.settings.get("attributeWeights"))
        hits = q.fold(q.rows_of(a.atoms, self.post, r.restrict_attributes), len(a.words.words), a.atoms, a.ways, a.options, weights)
        tried = q.rounds(a.words, str(self._setting(r, "removeWordsIfNoResults", "none")))
        found = self._syntax(a, rows.join(hits, "_id"))
        required = tried[0]
        if len(tried) > 1:
            counts = found.agg(*[F.count_if(q.fits(x)) for x in tried]).first()
            required = next((x for x, n in zip(tried, counts, strict=True) if n), tried[0])
        found = found.where(q.fits(required))
        if (mode := a.options.typo_tolerance) in ("min", "strict"):
            levels = sorted(x[0] for x in found.select("typos").distinct().collect())
            found = found.where(F.col("typos").isin(levels[: 1 if mode == "min" else 2])) if levels else found
        return found

    def _syntax(self, a: _Asked, rows: DataFrame) -> DataFrame:
        for phrase in a.words.phrases:
            with_it = matching.exact_phrase(self.post.read(phrase, []), phrase).select(F.col("object_id").alias("_id"))
            rows = rows.join(with_it, "_id", "left_semi")
        if a.words.excluded:
            rows = rows.join(self.post.read(a.words.excluded, []).select(F.col("object_id").alias("_id")).distinct(), "_id", "left_anti")
        return rows

    def matches(self, r: SearchRequest) -> DataFrame:
        """All documents that fit."""
        return self._found(self.ask(r)).select("_doc.*")

    def criteria(self, r: SearchRequest) -> DataFrame:
        """_id, typos, words, attribute, proximity, exact and score of all documents that fit."""
        return self._found(self.ask(r)).select("_id", "typos", "words", "attribute", "proximity", "exact", "score")

    def search(self, r: SearchRequest) -> SearchResult:
        a = self.ask(r)
        r, found = a.request, self._found(a)
        if self._setting(r, "attributeForDistinct") and (n := int(self._setting(r, "distinct", 0))):
            found = ranking.distinct(found, "k_group", n, self._keys(r), "_id").drop("group_rank")
        gone = set(r.hidden) - {i for i, _ in r.pins}
        found = found.where(~F.col("_id").isin(sorted(gone))) if gone else found
        total = found.count()
        shown = facets.counts(found.select("_doc.*"), [f for f in r.facets if self.facets.get(f, "") != "filterOnly"]) if r.facets else None
        size = r.length if r.length is not None else r.hits_per_page
        first = r.offset if r.offset is not None else r.page * r.hits_per_page
        hits = self._page(found, a, first, size) if size else None
        extra = {"page": r.page, "hitsPerPage": r.hits_per_page, "query": r.query, **a.rules}
        if r.click_analytics:
            extra["queryID"] = hashlib.md5(repr((self.now, r)).encode()).hexdigest()
        return SearchResult(hits, total, -(-total // r.hits_per_page) if r.hits_per_page else 0, shown, extra, self.place)

    def _keys(self, r: SearchRequest) -> list[Column]:
        """The order of hits: the sort that was asked for, else typos, distance, words, filters, proximity,
        attribute, exact words; then the custom ranking."""
        keys = [_way(x, f"k{n}") for n, x in enumerate([*r.sort, *(self._setting(r, "customRanking") or [])])]
        near = F.greatest("proximity", F.lit(int(self._setting(r, "minProximity", 1))))
        usual = [
            F.asc("typos"), *([geo.precision(F.col("distance"), r.precision).asc_nulls_last()] if r.around else []), F.desc(
                "words"), F.desc("filters"),
            near.asc(), F.asc("attribute"), F.desc("score"), F.desc("exact"),
        ]
        sort = len(r.sort)
        return [*keys[:sort], *([F.desc("filters")] if sort else usual), *keys[sort:]]

    def _page(self, found: DataFrame, a: _Asked, first: int, size: int) -> DataFrame:
        """A page of hits; places are decided on ids and keys, and only the page's documents are fetched."""
        r = a.request
        criteria = ["typos", "distance", "words", "filters", "proximity", "attribute", "exact", "score"]
        slim = found.drop("_doc", "covered")
        if r.pins or r.hidden:
            docs = (self.docs.where(self.condition(r)) if r.filter_promotes else self.docs).select(F.col(f"`{self.id}`").alias("_id"))
            placed = ranking.pin(docs, slim, r.pins, r.hidden, self._keys(r), "_id", first + size)
            placed = placed.where((F.col("slot") >= first) & (F.col("slot") < first + size)).select("_id", (F.col("slot")
                + 1).cast("int").alias("_place"), "pinned")
            placed = placed.join(slim.select("_id", *criteria), "_id", "left")
        else:
            placed = ranking.top(slim, self._keys(r), size, first, "_id").select("_id", F.col("pos").alias("_place"), F.lit(
                False).alias("pinned"), *criteria)
        rows = placed.join(self.docs.select(F.col(f"`{self.id}`").alias("_id"), F.struct("*").alias("_doc")), "_id")
        return self._shape(rows, a)

    # --- the shape of hits

    def _marks(self, rows: DataFrame, a: _Asked) -> DataFrame:
        """_id and marks (path, text, whole, word): what of each attribute a hit matched."""
        post = q.rows_of(a.atoms, self.post, a.request.restrict_attributes).withColumnRenamed("object_id", "_id")
        post = post.join(rows.select("_id"), "_id", "left_semi")
        found = []
        for n, atom in enumerate(a.atoms):
            begins = F.lit(atom.prefix) & F.startswith(F.col("token"), F.lit(atom.word)) & (F.col("token") != atom.word)
            words = [a.words.words[i] for w in a.ways if n in w.atoms for i in w.covers]
            mark = F.struct(F.when(begins, F.lit(atom.word)).otherwise(F.col("token")).alias("text"), (~begins).alias("whole"),
                F.array(*map(F.lit, dict.fromkeys(words))).alias("words"))
            found.append(F.when(q._hit(atom, a.options), mark))
        each = post.select("_id", "path", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("m"))
        return each.groupBy("_id").agg(F.collect_set(F.struct("path", "m.text", "m.whole", "m.words")).alias("_marks"))

    def _shape(self, rows: DataFrame, a: _Asked) -> DataFrame:
        r = a.request
        wanted = self._setting(r, "attributesToRetrieve") or ["*"]
        denied = set(self.settings.get("unretrievableAttributes") or [])
        keep = [c for c in self.docs.columns if c == self.id or (("*" in wanted or c in wanted) and c not in denied)]
        marked = [*r.highlight, *[x for x in self._setting(r, "attributesToHighlight") or [] if x not in r.highlight]]
        cut = [x.partition(":") for x in self._setting(r, "attributesToSnippet") or []]
        more = []
        if marked or cut:
            if a.atoms:
                rows = rows.join(self._marks(rows, a), "_id", "left")
            else:
                rows = rows.withColumn("_marks", F.lit(None).cast(
                    "array<struct<path:string,text:string,whole:boolean,words:array<string>>>"))
            tags = str(self._setting(r, "highlightPreTag", "<em>")), str(self._setting(r, "highlightPostTag", "</em>"))
            value = lambda c: F.col(f"_doc.`{c}`").cast("string")
            if marked:
                more.append(F.struct(*[_highlighted(value(c), c, a.words.words, tags).alias(c) for c in marked]).alias("_highlightResult"))
            if cut:
                around = lambda c: F.coalesce(F.get(_of(c), 0)["text"], F.lit(""))
                more.append(F.struct(*[F.struct(snippet(value(c), int(n or 10), around(c)).alias("value"), _level(c,
                    a.words.words).alias("matchLevel")).alias(c) for c, _, n in cut]).alias("_snippetResult"))
        if r.ranking_info:
            more.append(self._info(r))
        return rows.select(*[F.col(f"_doc.`{c}`").alias(c) for c in keep], F.col("_place").alias(self.place), *more)

    def _info(self, r: SearchRequest) -> Column:
        parts = [
            F.col("typos").alias("nbTypos"), F.lit(0).alias("firstMatchedWord"), F.col("proximity").alias("proximityDistance"),
                F.col("attribute").alias("attribute"),
            F.col("words").alias("words"), F.col("exact").alias("nbExactWords"), F.col("filters").alias("filters"), F.col(
                "score").alias("userScore"), F.col("pinned").alias("promoted"),
        ]
        if r.around:
            lat, lng = ("_doc._geoloc.lat", "_doc._geoloc.lng") if "_geoloc" in self.docs.columns else ("_doc.lat", "_doc.lng")
            at = F.struct(F.col(lat).alias("lat"), F.col(lng).alias("lng"), F.round("distance").cast("long").alias("distance"))
            parts += [geo.precision(F.col("distance"), r.precision).alias("geoDistance"), F.lit(r.precision
                if isinstance(r.precision, int) else 1).alias("geoPrecision"), at.alias("matchedGeoLocation")]
        return F.struct(*parts).alias("_rankingInfo")


def _way(rule: str, column: str) -> Column:
    """A sort key: missing values first when rising, last when falling."""
    return F.col(column).asc_nulls_first() if rule.startswith("asc") else F.col(column).desc_nulls_last()


def _of(path: str) -> Column:
    return F.filter(F.coalesce("_marks", F.array()), lambda m: m["path"] == path)


def _matched(path: str, words: Sequence[str]) -> Column:
    return F.array_intersect(F.array(*map(F.lit, dict.fromkeys(words))), F.flatten(
        F.transform(_of(path), lambda m: m["words"]))) if words else F.array().cast("array<string>")


def _level(path: str, words: Sequence[str]) -> Column:
    n = F.size(_matched(path, words))
    return F.when(n == 0, "none").when(n < len(set(words)), "partial").otherwise("full")


def _highlighted(text: Column, path: str, words: Sequence[str], tags: tuple[str, str]) -> Column:
    """value, matchLevel, matchedWords and fullyHighlighted of an attribute. A token is marked as it stands in the
    text, also where punctuation divides it; of a word that a prefix matched, the prefix."""
    free = r"[^\p{L}\p{N}\s]*"
    spelled = lambda m: F.regexp_replace(m["text"], r"(?<=.)(?=.)", free.replace("\\", "\\\\"))
    pattern = F.transform(F.reverse(F.array_sort(F.transform(_of(path),
        lambda m: F.struct(F.char_length(m["text"]).alias("n"), m["text"].alias("text"), m["whole"].alias("whole"))))),
        lambda m: F.when(m["whole"], F.concat(spelled(m), F.lit(r"(?![\p{L}\p{N}])"))).otherwise(spelled(m)))
    found = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])("), F.array_join(pattern, "|"), F.lit(")"))
    value = F.when(F.size(_of(path)) > 0, F.regexp_replace(text, found, F.lit(f"{tags[0]}$1{tags[1]}"))).otherwise(text)
    bare = F.regexp_replace(F.regexp_replace(text, found, F.lit("")), r"[^\p{L}\p{N}]", "")
    whole = F.coalesce((F.size(_of(path)) > 0) & (bare == ""), F.lit(False))
    return F.struct(value.alias("value"), _level(path, words).alias("matchLevel"), _matched(path, words).alias("matchedWords"),
        whole.alias("fullyHighlighted"))
