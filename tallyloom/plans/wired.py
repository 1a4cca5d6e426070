"""Registered queries in which parts meet: translated names, pictures and prices by printing, types with their overrides, families of decks, advice with its fallback."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import advisor, catalogue, hybrid, ml, popularity, ranks, tags
from .more import _COOC, _FAMILIES, _TYPE, _faces, _families, _lines_of_type, _more, _predictions, _q, _typed
from .queries import Derived

#: The type that is counted apart, and what stands for its absence (fixed values of the queries).
LAND = "SMALL"


class Wide(Derived):
    """With more tags for an item: the words of its name, its kind, and for some the group of its vector."""

    def tags(self):
        kind = self.items().select("item", F.lower("kind").alias("tag"))
        near = self.vectors().where("item % 3 = 0").select("item", F.concat(F.lit("near "), F.col("cluster").cast("string")).alias("tag"))
        return super().tags().unionByName(kind).unionByName(near)


def _wide(f):
    return lambda spark, sf_dir: _q(lambda t: f(Wide(t.spark, t.folder)))(spark, sf_dir)


def editions(t: Derived):
    """(edition, item, lang, printed_name, image, uri): a printing for each item and supplier; names in a second language, some without a picture."""
    rows = t.read("lineitem").select(F.col("l_partkey").alias("item"), F.col("l_suppkey").alias("supplier")).distinct().join(t.items().select("item", "name", "brand"), "item")
    foreign = F.col("supplier") % 3 == 0
    image = F.when(F.col("supplier") % 7 != 0, F.concat(F.lit("img/"), "item", F.lit("/"), "supplier"))
    return rows.select(
        (F.col("item") * 1_000_000 + F.col("supplier")).alias("edition"), "item", F.when(foreign, "fr").otherwise("en").alias("lang"), F.when(foreign, F.concat_ws(" ", F.reverse("name"), "brand")).alias("printed_name"),
        image.alias("image"), F.concat(F.lit("card/"), "item", F.lit("/"), "supplier").alias("uri"),
    )


def edition_prices(t: Derived):
    """(edition, day, currency, price) of every day."""
    return t.printings().select((F.col("item") * 1_000_000 + F.col("printing")).alias("edition"), "day", "currency", "price")


def _described(t: Derived):
    return t.items().select("item", "name", "cost", F.repeat(F.concat("name", F.lit(" ")), F.lit(30)).alias("text"))


def _composition(t: Derived):
    named = _lines_of_type(t)
    lands = advisor.face_lands(named, _faces(t), "small")
    return advisor.composition_by_type(t.decks(), t.lines(), t.baskets(), named.select("item", "name"), advisor.face_names(_typed(t)), lands, LAND)


def _family_of_items(t: Derived):
    return t.vectors().select("item", "cluster").join(_families(t), "cluster", "left").select("item", F.coalesce("family", F.lit("other")).alias("family"))


def _named_as_basics(t: Derived):
    """mine and rates by name, where every seventh item has the name of a basic."""
    basics = F.array(*map(F.lit, popularity.SIX_BASICS))
    name = F.when(F.col("item") % 7 == 0, F.get(basics, (F.col("item") % 6).cast("int"))).otherwise(F.concat(F.lit("item "), "item"))
    return t.mine().select("owner", "leader", name.alias("item")).distinct(), popularity.without_basics(t.rates().select("leader", name.alias("item"), "n")).groupBy("leader", "item").agg(F.sum("n").alias("n"))


def _unfilled(t: Derived):
    """Features before missing values are filled: items without a vector or price, and prices that are no numbers."""
    price = t.items().select("item", F.when(F.col("cost") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("price")).alias("price"))
    return t.profile().join(t.vectors().select("item", "cluster"), "item", "left").join(price.where("item % 11 <> 0"), "item", "left").select("tfidf_norm", F.col("cluster").cast("double").alias("cluster"), "price")


def _removals(t: Derived):
    known = t.rates().where("leader >= 5")
    return popularity.removals_or_support(t.mine(), known, t.frequency(), t.basket_items())


QUERIES = {
    "q02_tfidf_in_order": _q(lambda t: ranks.ranked(t.profile().select("leader", "item", "tfidf"), ["leader", F.desc("tfidf"), "item"]), True),
    "v5_seconds_since": _q(lambda t: catalogue.since_last(t.read("orders").select(F.col("o_custkey").alias("owner"), F.col("o_orderdate").cast("string").alias("day")), "owner", "day")),
    "q05_removals_or_support": _q(_removals, True),
    "q04_additions_without_basics": _q(lambda t: popularity.additions(*_named_as_basics(t))),
    "q09_composition_by_type": _q(_composition, True),
    "q14_search_with_printings": _q(lambda t: catalogue.search_printings(_described(t), editions(t), edition_prices(t), "%red%", "R", 100)),
    "q15_autocomplete_translated": _q(lambda t: catalogue.translated_autocomplete(t.items(), editions(t), "r", 20)),
    "q16_prices_by_name": _q(lambda t: catalogue.price_by_name(t.items(), editions(t), edition_prices(t), "R")),
    "q17_images_by_name": _q(lambda t: catalogue.image_by_name(t.items(), editions(t), "en")),
    "q35_discriminant_of_half": _wide(lambda t: tags.discriminant(t.given(), 0.5)),
    "q38_accuracy_of_three_tags": _wide(lambda t: tags.accuracy_by_cluster(_predictions(t), t.vectors(), tags.eligible(t.tagged(), 3))),
    "q42_clusters_of_deck": _q(lambda t: hybrid.shares(t.decks(), t.vectors(), "cluster")),
    "q42_families_of_deck": _q(lambda t: hybrid.shares(t.decks(), _family_of_items(t), "family")),
    "v8_empty_before_filling": _q(lambda t: ml.empty_counts(_unfilled(t), ["tfidf_norm", "cluster", "price"])),
}

_ED = """ed AS (SELECT DISTINCT l_partkey * 1000000 + l_suppkey AS edition, l_partkey AS item, CASE WHEN l_suppkey % 3 = 0 THEN 'fr' ELSE 'en' END AS lang, CASE WHEN l_suppkey % 3 = 0 THEN reverse(p_name) || ' ' || p_brand END AS printed_name,
CASE WHEN l_suppkey % 7 <> 0 THEN 'img/' || l_partkey || '/' || l_suppkey END AS image, 'card/' || l_partkey || '/' || l_suppkey AS uri FROM lineitem JOIN part ON l_partkey = p_partkey)"""
_PR = "pr AS (SELECT item * 1000000 + printing AS edition, day, currency, price FROM printings)"
_KNOWN = "kr AS (SELECT * FROM rates WHERE leader >= 5)"
_NAME = "CASE WHEN item % 7 = 0 THEN ['Plains', 'Island', 'Swamp', 'Mountain', 'Forest', 'Wastes'][item % 6 + 1] ELSE 'item ' || item END"
_TYPES = f"""named AS (SELECT p_partkey AS item, replace(p_name, ' ', ' // ') AS name, p_type || ' // ' || p_name AS line, p_size AS cost, {_TYPE} AS type, p_type FROM part),
front AS (SELECT trim(string_split(name, '//')[1]) AS name, 1 AS p, item, type, cost FROM named WHERE type IS NOT NULL AND contains(name, '//')),
known AS (SELECT name, first(type ORDER BY p, item) AS type, first(cost ORDER BY p, item) AS cost FROM (SELECT name, 0 AS p, item, type, cost FROM named WHERE type IS NOT NULL UNION ALL SELECT * FROM front) GROUP BY name),
land AS (SELECT name FROM named WHERE (cost % 3 = 0 AND p_type ILIKE '%small%') OR line ILIKE '% // %small%'),
lands AS (SELECT name FROM land UNION SELECT trim(string_split(name, '//')[1]) FROM land WHERE contains(name, '//')),
typed AS (SELECT n.item, CASE WHEN n.name IN (SELECT name FROM lands) THEN 'SMALL' ELSE k.type END AS type, CASE WHEN n.name IN (SELECT name FROM lands) THEN NULL WHEN k.type <> 'SMALL' THEN k.cost END AS cost FROM named n LEFT JOIN known k ON n.name = k.name),
own AS (SELECT leader, type, sum(qty) AS own FROM decks JOIN typed USING (item) WHERE type IS NOT NULL GROUP BY 1, 2),
corp AS (SELECT leader, type, round(CAST(sum(qty)::DOUBLE / any_value(total) AS DECIMAL(20,8)), 1)::DOUBLE AS corpus_mean FROM lines JOIN typed USING (item) JOIN totals USING (leader) WHERE type IS NOT NULL GROUP BY 1, 2),
mc AS (SELECT leader, round(CAST(sum(cost * qty)::DOUBLE / sum(qty) AS DECIMAL(20,8)), 2)::DOUBLE AS mean_cost FROM decks JOIN typed USING (item) WHERE cost IS NOT NULL GROUP BY 1)"""


def _with_wide_tags(sql: str) -> str:
    plain = "SELECT p_partkey AS item, unnest(string_split(p_name, ' ')) AS tag FROM part"
    return sql.replace(f"tags AS ({plain})", f"tags AS ({plain} UNION ALL SELECT p_partkey, lower(p_type) FROM part UNION ALL SELECT vec_id, 'near ' || label FROM embeddings WHERE vec_id % 3 = 0)")


def _sql_of(name: str) -> str:
    from .more import SQL as known

    return known[name]


SQL = {
    "q02_tfidf_in_order": _more("SELECT row_number() OVER (ORDER BY leader, tfidf DESC, item) AS rank, leader, item, tfidf FROM profile"),
    "v5_seconds_since": "SELECT o_custkey AS owner, strftime(max(o_orderdate), '%Y-%m-%d') AS last, date_diff('second', max(o_orderdate), (SELECT max(o_orderdate) FROM orders))::BIGINT AS seconds FROM orders GROUP BY 1",
    "q05_removals_or_support": _more(
        """SELECT owner, row_number() OVER (PARTITION BY owner ORDER BY support, frequency, item) AS rank, item, support, frequency, way FROM (
        SELECT m.owner, m.item, CASE WHEN k.leader IS NOT NULL THEN coalesce(r.n, 0) ELSE coalesce(s.support, 0) END AS support, coalesce(f.n, 0) AS frequency, CASE WHEN k.leader IS NOT NULL THEN 'leader' ELSE 'together' END AS way
        FROM mine m LEFT JOIN (SELECT DISTINCT leader FROM kr) k ON m.leader = k.leader LEFT JOIN kr r ON m.leader = r.leader AND m.item = r.item LEFT JOIN frequency f ON m.item = f.item LEFT JOIN sup s ON m.owner = s.owner AND m.item = s.item) QUALIFY rank <= 20""",
        _COOC, _KNOWN, "un AS (SELECT DISTINCT owner, item FROM mine WHERE leader < 5)", "sup AS (SELECT a.owner, a.item, sum(co.n)::BIGINT AS support FROM un a JOIN co ON a.item = co.item JOIN un b ON a.owner = b.owner AND co.other = b.item GROUP BY 1, 2)",
    ),
    "q04_additions_without_basics": _more(
        "SELECT owner, row_number() OVER (PARTITION BY owner ORDER BY n DESC, r.item) AS rank, r.item, n AS score FROM (SELECT DISTINCT owner, leader FROM nm) o JOIN nr r USING (leader) WHERE NOT EXISTS (FROM nm m WHERE m.owner = o.owner AND m.item = r.item) QUALIFY rank <= 20",
        f"nm AS (SELECT DISTINCT owner, leader, {_NAME} AS item FROM mine)", f"nr AS (SELECT leader, item, sum(n)::BIGINT AS n FROM (SELECT leader, {_NAME} AS item, n FROM rates) WHERE item NOT IN ('Plains', 'Island', 'Swamp', 'Mountain', 'Forest', 'Wastes') GROUP BY 1, 2)",
    ),
    "q09_composition_by_type": _more("SELECT leader, type, coalesce(own, 0)::BIGINT AS own, coalesce(corpus_mean, 0) AS corpus_mean, mean_cost FROM own FULL JOIN corp USING (leader, type) LEFT JOIN mc USING (leader)", _TYPES),
    "q14_search_with_printings": _more(
        """SELECT i.item, name, cost, CASE WHEN length(text) > 280 THEN substr(text, 1, 280) || '…' ELSE text END AS text, coalesce(d.image, e.image) AS image, coalesce(d.uri, e.uri) AS uri, price FROM (SELECT p_partkey AS item, p_name AS name, p_size AS cost, repeat(p_name || ' ', 30) AS text FROM part WHERE p_name ILIKE '%red%' ORDER BY p_size NULLS LAST, p_name, p_partkey LIMIT 100) i
        LEFT JOIN (SELECT item, image, uri FROM ed JOIN pr USING (edition) WHERE currency = 'R' AND price > 0 QUALIFY row_number() OVER (PARTITION BY item ORDER BY price DESC, edition) = 1) d ON i.item = d.item
        LEFT JOIN (SELECT item, min(edition) AS edition FROM ed GROUP BY item) f ON i.item = f.item LEFT JOIN ed e ON f.edition = e.edition
        LEFT JOIN (SELECT item, min(price) AS price FROM ed JOIN pr USING (edition) WHERE currency = 'R' AND price > 0 GROUP BY item) m ON i.item = m.item""", _ED, _PR,
    ),
    "q15_autocomplete_translated": _more(
        """SELECT name FROM (SELECT name, min(b) AS b, min(cost) AS cost FROM (SELECT * FROM (SELECT p_name AS name, min(p_size) AS cost, 0 AS b FROM part WHERE p_name ILIKE 'r%' GROUP BY 1 ORDER BY 2 NULLS LAST, 1 LIMIT 20)
        UNION ALL SELECT * FROM (SELECT p_name AS name, min(p_size) AS cost, 1 AS b FROM part JOIN ed ON item = p_partkey WHERE printed_name ILIKE 'r%' GROUP BY 1 ORDER BY 2 NULLS LAST, 1 LIMIT 20)) GROUP BY name) ORDER BY b, cost NULLS LAST, name LIMIT 20""", _ED,
    ),
    "q16_prices_by_name": _more("SELECT lower(p_name) AS name, min(price) AS price FROM pr JOIN ed USING (edition) JOIN part ON item = p_partkey WHERE currency = 'R' AND price > 0 GROUP BY 1", _ED, _PR),
    "q17_images_by_name": _more("SELECT lower(p_name) AS name, first(image ORDER BY edition) AS image FROM ed JOIN part ON item = p_partkey WHERE lang = 'en' AND image IS NOT NULL GROUP BY 1", _ED),
    "q35_discriminant_of_half": _with_wide_tags(_sql_of("q35_discriminant").replace("most > 0.1", "most > 0.5")),
    "q38_accuracy_of_three_tags": _with_wide_tags(_sql_of("q38_accuracy_by_cluster").replace("HAVING count(*) >= 2", "HAVING count(*) >= 3")),
    "q42_clusters_of_deck": _more("SELECT leader, cluster, count(*) AS n, round(count(*)::DOUBLE / any_value(lines), 4) AS share FROM decks JOIN vectors USING (item) JOIN (SELECT leader, count(*) AS lines FROM decks GROUP BY leader) USING (leader) GROUP BY 1, 2"),
    "q42_families_of_deck": _more("SELECT leader, coalesce(family, 'other') AS family, count(*) AS n, round(count(*)::DOUBLE / any_value(lines), 4) AS share FROM decks JOIN vectors USING (item) LEFT JOIN fam USING (cluster) JOIN (SELECT leader, count(*) AS lines FROM decks GROUP BY leader) USING (leader) GROUP BY 1, 2", _FAMILIES),
    "v8_empty_before_filling": _more(
        "SELECT unnest(['tfidf_norm', 'cluster', 'price']) AS feature, unnest([count(*) FILTER (tfidf_norm IS NULL OR isnan(tfidf_norm)), count(*) FILTER (cluster IS NULL), count(*) FILTER (p_retailprice IS NULL OR item % 11 = 0 OR p_size % 5 = 0)]) AS empty FROM profile LEFT JOIN vectors USING (item) LEFT JOIN part ON item = p_partkey",
    ),
}
