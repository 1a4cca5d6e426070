"""The registered queries on the driver's tables, and DuckDB SQL for each that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import advisor, catalogue, density, hybrid, layout, ml, popularity, stats, tags, vectors
from ..sources.driver_tables import BASIC, Tables
from ..storage import Scratch, stored


#: What is large, and read often where it is read at all.
LARGE = {"rates", "profile", "frequency", "mine"}


class Derived(Tables):
    """Canonical tables and what is derived from them. With `keep`, the large ones that are read often are stored once."""

    def __init__(self, spark: SparkSession, folder: str, keep: Scratch | None = None):
        super().__init__(spark, folder)
        self.made: dict[str, DataFrame] = {}
        self.keep = keep

    def once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if name not in self.made:
            self.made[name] = self.keep(make(), name) if self.keep and name in LARGE else make()
        return self.made[name]

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        return self.keep(df, name) if self.keep else stored(df, name)

    def basket_items(self) -> DataFrame:
        return self.once("basket_items", super().basket_items)

    def decks(self) -> DataFrame:
        return self.once("decks", super().decks)

    def rates(self) -> DataFrame:
        return self.once("rates", lambda: stats.leader_rates(self.basket_items(), self.baskets()))

    def frequency(self) -> DataFrame:
        return self.once("frequency", lambda: stats.global_frequency(self.basket_items(), self.baskets()))

    def profile(self) -> DataFrame:
        return self.once("profile", lambda: stats.tfidf(self.rates(), self.frequency()))

    def mine(self) -> DataFrame:
        """(owner, leader, item): all that an owner has ever put in a basket."""
        return self.once("mine", lambda: self.lines().join(self.items().where(F.col("kind") != BASIC).select("item"), "item").select("owner", "leader", "item").distinct())

    def tagged(self) -> DataFrame:
        return tags.tagged(self.tags(), self.vectors())

    def given(self) -> DataFrame:
        return self.once("given", lambda: tags.cluster_given_tag(self.tagged()))

    def weights(self) -> DataFrame:
        return self.once("weights", lambda: tags.leader_weights(self.profile(), self.vectors()))

    def leader_vectors(self) -> DataFrame:
        return self.once("leader_vectors", lambda: hybrid.leader_vectors(self.profile(), self.vectors()))

    def hybrids(self) -> DataFrame:
        """Scores of all items of the leaders' profiles and decks."""

        def make() -> DataFrame:
            pairs = self.profile().select("leader", "item").unionByName(self.decks().select("leader", "item")).distinct()
            scores = hybrid.tag_scores(pairs, self.tags(), self.given(), self.weights())
            return hybrid.hybrid(pairs, self.profile(), self.vectors(), self.weights(), scores, self.leader_vectors())

        return self.once("hybrids", make)

    def gaps(self) -> DataFrame:
        return self.once("gaps", lambda: hybrid.gaps(self.decks(), self.vectors(), self.weights()))

    def protected(self) -> DataFrame:
        """(item): items that are never cut, those on promotion."""
        return self.items().where("kind = 'PROMO'").select("item")


def _q(f: Callable[[Derived], DataFrame], kept: bool = False) -> Callable[[SparkSession, str], DataFrame]:
    """f on the tables of a folder; if kept, large derived tables are stored while it runs, and its result is."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        if kept:
            with Scratch() as keep:
                out = stored(f(Derived(spark, sf_dir, keep)), "result")
        else:
            out = f(Derived(spark, sf_dir))
        return out.withColumn("rank", F.col("rank").cast("long")) if "rank" in out.columns else out

    return run


def _additions(t: Derived) -> DataFrame:
    return hybrid.additions(t.hybrids(), t.rates(), t.gaps(), t.vectors(), t.decks(), t.item_colours(), t.leader_colours())


def _cuts(t: Derived) -> DataFrame:
    return hybrid.cuts(t.hybrids(), t.gaps(), t.vectors(), t.decks(), t.rates(), t.protected())


def _features(t: Derived) -> DataFrame:
    return ml.features(t.profile(), t.frequency(), t.items(), t.vectors(), t.leader_vectors(), t.item_colours(), t.leader_colours())


FEATURES = ["cosine", "tfidf_norm", "idf", "cost", "frequency", "compatible"]


def _trained(t: Derived):
    rows = t.stored(_features(t), "features")
    return ml.rate_model(rows, ml.held_out(rows, "leader"), FEATURES)


def _model(t: Derived) -> DataFrame:
    return ml.errors(_trained(t)[1], "label", "prediction")


def _upsert(t: Derived) -> DataFrame:
    old = t.printings().groupBy("item", "printing").agg(F.min("price").alias("price"), F.min("day").alias("day"))
    new = t.printings().where("currency = 'R'")
    return catalogue.upserted(old, new.select("item", "printing", "price", "day").distinct(), ["item", "printing"], F.struct("day", "price"))


def _absent(t: Derived) -> DataFrame:
    old = t.rates().select("leader", "item")
    return catalogue.inserted_if_absent(old, t.decks().select("leader", "item"), ["leader", "item"])


QUERIES = {
    "q01_global_frequency": _q(lambda t: t.frequency()),
    "q01_leader_rates": _q(lambda t: t.rates()),
    "q02_tfidf": _q(lambda t: t.profile()),
    "q03_signatures": _q(lambda t: stats.signatures(t.profile())),
    "q03_summary": _q(lambda t: stats.summary(t.profile(), t.rates())),
    "q04_additions": _q(lambda t: popularity.additions(t.mine(), t.rates())),
    "q04_cooccurrence": _q(lambda t: popularity.cooccurrence_scores(t.mine(), t.basket_items())),
    "q05_removals": _q(lambda t: popularity.removals(t.mine(), t.rates(), t.frequency())),
    "q06_collection_suggestions": _q(lambda t: advisor.suggestions(advisor.available(t.collection(), t.decks(), t.opened()), t.rates(), t.decks())),
    "q07_transfers": _q(lambda t: advisor.transfers(t.decks(), t.rates())),
    "q08_cuts": _q(lambda t: advisor.cuts(t.decks(), t.rates(), t.items(), t.baskets(), BASIC)),
    "q09_composition": _q(lambda t: advisor.composition(t.decks(), t.lines(), t.items(), t.baskets(), BASIC)),
    "q09_mean_cost": _q(lambda t: advisor.mean_cost(t.decks(), t.items(), BASIC)),
    "q10_leader_suggestions": _q(lambda t: advisor.leader_suggestions(t.rates(), t.decks())),
    "q11_leader_detection": _q(lambda t: advisor.detected_leader(t.basket_items().select("basket_id", "item"), t.rates())),
    "q12_best_leaders": _q(lambda t: advisor.best_leader(t.collection().select("item", F.lit("list").alias("source")), t.rates(), t.decks())),
    "q12_not_found": _q(lambda t: advisor.not_found(t.collection(), t.rates())),
    "q14_search": _q(lambda t: catalogue.search(t.items(), t.printings(), "%RED%", 100)),
    "q15_autocomplete": _q(lambda t: catalogue.autocomplete([t.items().where(F.col("name").ilike("s%")), t.items().where(F.col("name").ilike("% s%"))], 8)),
    "q16_least_prices": _q(lambda t: catalogue.least_prices(t.printings(), "R")),
    "q17_printings": _q(lambda t: catalogue.best_printings(t.printings())),
    "q18_item_source": _q(lambda t: advisor.item_source(t.items(), t.decks(), t.collection(), t.opened())),
    "q20_basic_counts": _q(lambda t: t.decks().join(t.items().where(F.col("kind") == BASIC), "item").groupBy("leader").agg(F.sum("qty").alias("basics"))),
    "q22_opened": _q(lambda t: t.opened()),
    "q24_neighbours": _q(lambda t: vectors.neighbours(t.vectors().where("item % 50 = 0"), t.vectors())),
    "q25_leader_vectors": _q(lambda t: vectors.weighted_means(t.profile().join(t.vectors(), "item").select("leader", "vec", F.col("tfidf_norm").alias("w")), "leader").select("leader", F.col("i").alias("component"), F.round("value", 6).alias("value"))),
    "q33_centroid_distances": _q(lambda t: vectors.centroid_distances(t.vectors()).select("item", "cluster", F.round("distance", 6).alias("distance"))),
    "q35_cluster_given_tag": _q(lambda t: t.given()),
    "q35_tag_given_cluster": _q(lambda t: tags.tag_given_cluster(tags.tagged(t.tags(), t.vectors()))),
    "q35_semantics": _q(lambda t: tags.semantics(tags.tag_given_cluster(tags.tagged(t.tags(), t.vectors())))),
    "q36_additive_prediction": _q(lambda t: tags.additive_prediction(t.tags(), t.given())),
    "q36_bayes_prediction": _q(lambda t: tags.bayes_prediction(t.tags(), tags.tagged(t.tags(), t.vectors()))),
    "q37_leader_prediction": _q(lambda t: tags.leader_prediction(tags.additive_prediction(t.tags(), t.given()), t.weights())),
    "q38_accuracy": _q(lambda t: tags.accuracy(tags.additive_prediction(t.tags(), t.given()), t.vectors())),
    "q39_hybrid": _q(lambda t: t.hybrids().select("leader", "item", "cosine", "hybrid"), True),
    "q42_deck_profile": _q(lambda t: hybrid.deck_profile(t.decks(), t.vectors(), t.leader_vectors()), True),
    "q43_gaps": _q(lambda t: t.gaps(), True),
    "q44_deck_additions": _q(_additions, True),
    "q45_deck_cuts": _q(lambda t: _cuts(t).withColumn("reasons", F.array_join("reasons", "|")), True),
    "q46_replacements": _q(lambda t: hybrid.replacements(_cuts(t), _additions(t)), True),
    "q47_global_score": _q(lambda t: hybrid.global_score(hybrid.deck_profile(t.decks(), t.vectors(), t.leader_vectors()), t.gaps()), True),
    "q26_features": _q(_features, True),
    "q27_held_out": _q(lambda t: ml.held_out(t.baskets(), "leader")),
    "q28_rate_model": _q(_model, True),
    "q30_ranking_metrics": _q(lambda t: ml.ranking_metrics(t.profile(), "rate", "tfidf")),
    "q31_clusters": _q(lambda t: ml.clustered(t.vectors())),
    "q31_layout": _q(lambda t: layout.laid_out(t.vectors()).select("item", F.get("place", F.lit(0)).alias("x"), F.get("place", F.lit(1)).alias("y"))),
    "q32_methods": _q(lambda t: ml.clusterings(t.vectors())[1]),
    "q32_dense_clusters": _q(lambda t: density.dense_clusters(t.vectors())),
    "m1_upsert": _q(_upsert),
    "m2_insert_if_absent": _q(_absent),
    "m3_deck_moves": _q(lambda t: catalogue.moved(t.decks(), t.decks().select("leader", "item", F.when(F.col("item") % 2 == 0, -F.col("qty")).otherwise(F.lit(1)).alias("delta")))),
    "v1_row_counts": _q(lambda t: catalogue.checked({n: t.read(n) for n in ("customer", "lineitem", "nation", "orders", "part", "supplier")})),
    "v6_latest_prices": _q(lambda t: catalogue.latest_prices(t.printings())),
}

_CTE = {
    "baskets": "SELECT o_orderkey AS basket_id, c_nationkey AS leader, o_custkey AS owner FROM orders JOIN customer ON o_custkey = c_custkey",
    "lines": "SELECT basket_id, leader, owner, l_partkey AS item, l_quantity::BIGINT AS qty FROM lineitem JOIN baskets ON l_orderkey = basket_id",
    "bi": "SELECT DISTINCT basket_id, leader, item FROM lines JOIN part ON item = p_partkey WHERE p_type <> 'ECONOMY'",
    "mine": "SELECT DISTINCT owner, leader, item FROM lines JOIN part ON item = p_partkey WHERE p_type <> 'ECONOMY'",
    "totals": "SELECT leader, count(*) AS total FROM baskets GROUP BY leader",
    "rates": "SELECT leader, item, count(*) AS n, any_value(total) AS total, round(100::DOUBLE * count(*) / any_value(total), 4) AS rate FROM bi JOIN totals USING (leader) GROUP BY leader, item",
    "frequency": "SELECT item, count(*) AS n, (SELECT count(*) FROM baskets) AS total, round(100::DOUBLE * count(*) / (SELECT count(*) FROM baskets), 4) AS frequency, count(DISTINCT leader) AS leaders, round(ln((SELECT count(DISTINCT leader) FROM bi)::DOUBLE / count(DISTINCT leader)), 6) AS idf FROM bi GROUP BY item",
    "raw": "SELECT leader, item, rate, coalesce(idf, 0) AS idf, rate / 100 * coalesce(idf, 0) AS t FROM rates LEFT JOIN frequency USING (item)",
    "profile": "SELECT leader, item, rate, idf, round(t, 6) AS tfidf, round(CASE WHEN max(t) OVER (PARTITION BY leader) = 0 THEN 0 ELSE t / max(t) OVER (PARTITION BY leader) END, 6) AS tfidf_norm FROM raw",
    "best_owner": "SELECT leader, owner FROM (SELECT leader, owner, row_number() OVER (PARTITION BY leader ORDER BY count(*) DESC, owner) AS r FROM baskets GROUP BY leader, owner) WHERE r = 1",
    "decks": "SELECT leader, item, sum(qty)::BIGINT AS qty FROM lines JOIN best_owner USING (leader, owner) GROUP BY leader, item",
    "collection": "SELECT l_partkey AS item, count(*) AS qty FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1",
    "opened": "SELECT DISTINCT l_partkey AS item FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_acctbal > 9000",
    "printings": "SELECT l_partkey AS item, l_suppkey AS printing, round(l_extendedprice / l_quantity, 8) AS price, strftime(l_shipdate, '%Y-%m-%d') AS day, l_returnflag AS currency FROM lineitem",
    "tags": "SELECT p_partkey AS item, unnest(string_split(p_name, ' ')) AS tag FROM part",
    "vectors": "SELECT vec_id AS item, embedding::DOUBLE[] AS vec, label AS cluster FROM embeddings",
    "tagged": "SELECT item, tag, cluster FROM tags JOIN vectors USING (item)",
    "given": "SELECT tag, cluster, round(count(DISTINCT item)::DOUBLE / any_value(n), 4) AS p FROM tagged JOIN (SELECT tag, count(DISTINCT item) AS n, count(*) AS c FROM tagged GROUP BY tag) USING (tag) WHERE c >= 5 GROUP BY tag, cluster",
    "given2": "SELECT cluster, tag, round(count(DISTINCT item)::DOUBLE / any_value(n), 4) AS p FROM tagged JOIN (SELECT cluster, count(DISTINCT item) AS n FROM tagged GROUP BY cluster) USING (cluster) GROUP BY cluster, tag",
    "lw": "SELECT leader, cluster, sum(tfidf_norm) AS s, avg(tfidf_norm) AS m FROM profile JOIN vectors USING (item) GROUP BY leader, cluster",
    "weights": "SELECT leader, cluster, round(CASE WHEN sum(s) OVER (PARTITION BY leader) = 0 THEN s ELSE s / sum(s) OVER (PARTITION BY leader) END, 6) AS weight, m AS mean FROM lw",
    "additive": "SELECT * FROM (SELECT item, row_number() OVER (PARTITION BY item ORDER BY score DESC, cluster) AS rank, cluster, score FROM (SELECT item, cluster, round(s / sum(s) OVER (PARTITION BY item), 6) AS score FROM (SELECT item, cluster, sum(p) AS s FROM (SELECT DISTINCT item, tag FROM tags) JOIN given USING (tag) GROUP BY item, cluster))) WHERE rank <= 5",
    "avail": "SELECT item, 'collection' AS source FROM collection LEFT JOIN (SELECT item, count(DISTINCT leader) AS used FROM decks GROUP BY item) USING (item) WHERE qty > coalesce(used, 0)",
    "candidates": "SELECT * FROM avail UNION ALL SELECT item, 'opened' FROM opened WHERE item NOT IN (SELECT item FROM avail) AND item NOT IN (SELECT item FROM decks)",
}


def _sql(body: str) -> str:
    return "WITH " + ", ".join(f"{k} AS ({v})" for k, v in _CTE.items()) + " " + body


_BEST = "SELECT item, source, leader, rate FROM (SELECT c.item, source, r.leader, rate, row_number() OVER (PARTITION BY c.item ORDER BY rate DESC, r.leader) AS r FROM {0} c JOIN rates r ON c.item = r.item WHERE (r.leader, c.item) NOT IN (SELECT leader, item FROM decks)) WHERE r = 1"

SQL = {
    k: _sql(v)
    for k, v in {
        "q01_global_frequency": "SELECT * FROM frequency",
        "q01_leader_rates": "SELECT * FROM rates",
        "q02_tfidf": "SELECT * FROM profile",
        "q03_signatures": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY leader ORDER BY tfidf DESC, item) AS rank FROM profile) WHERE rank <= 20",
        "q03_summary": "SELECT leader, count(*) AS unique_items, round(avg(tfidf), 4) AS mean_tfidf, max(tfidf) AS max_tfidf, first(item ORDER BY tfidf DESC, item) AS top_item, any_value(total) AS deck_count FROM profile JOIN totals USING (leader) GROUP BY leader",
        "q04_additions": "SELECT * FROM (SELECT owner, row_number() OVER (PARTITION BY owner ORDER BY n DESC, r.item) AS rank, r.item, n AS score FROM (SELECT DISTINCT owner, leader FROM mine) o JOIN rates r USING (leader) WHERE NOT EXISTS (FROM mine m WHERE m.owner = o.owner AND m.item = r.item)) WHERE rank <= 20",
        "q04_cooccurrence": "SELECT * FROM (SELECT s.owner, row_number() OVER (PARTITION BY s.owner ORDER BY score DESC, s.item) AS rank, s.item, score FROM (SELECT owner, other AS item, sum(n)::BIGINT AS score FROM (SELECT DISTINCT owner, item FROM mine) JOIN (SELECT a.item, b.item AS other, count(*) AS n FROM bi a JOIN bi b USING (basket_id) WHERE a.item <> b.item GROUP BY 1, 2) USING (item) GROUP BY 1, 2) s LEFT JOIN (SELECT DISTINCT owner, item FROM mine) m ON s.owner = m.owner AND s.item = m.item WHERE m.item IS NULL) WHERE rank <= 20",
        "q05_removals": "SELECT * FROM (SELECT owner, row_number() OVER (PARTITION BY owner ORDER BY coalesce(r.n, 0), coalesce(f.n, 0), m.item) AS rank, m.item, coalesce(r.n, 0) AS support, coalesce(f.n, 0) AS frequency FROM mine m LEFT JOIN rates r ON m.leader = r.leader AND m.item = r.item LEFT JOIN frequency f ON m.item = f.item) WHERE rank <= 20",
        "q06_collection_suggestions": f"SELECT row_number() OVER (ORDER BY rate DESC, item) AS rank, * FROM ({_BEST.format('candidates')}) ORDER BY rank LIMIT 40",
        "q07_transfers": "SELECT row_number() OVER (ORDER BY gain DESC, item) AS rank, item, from_leader, to_leader, from_rate, to_rate, gain FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY gain DESC, from_leader, to_leader) AS r FROM (SELECT d.item, d.leader AS from_leader, b.leader AS to_leader, a.rate AS from_rate, b.rate AS to_rate, round(b.rate - a.rate, 4) AS gain FROM decks d JOIN rates a ON d.leader = a.leader AND d.item = a.item JOIN rates b ON d.item = b.item AND b.leader <> d.leader AND b.rate > a.rate WHERE (b.leader, b.item) NOT IN (SELECT leader, item FROM decks))) WHERE r = 1 ORDER BY rank LIMIT 30",
        "q08_cuts": "SELECT d.leader, row_number() OVER (PARTITION BY d.leader ORDER BY coalesce(rate, 0), d.item) AS rank, d.item, coalesce(rate, 0) AS rate, coalesce(n, 0) AS n, t.total FROM decks d JOIN part ON d.item = p_partkey AND p_type <> 'ECONOMY' JOIN totals t ON d.leader = t.leader LEFT JOIN rates r ON d.leader = r.leader AND d.item = r.item",
        "q09_composition": "SELECT leader, kind, coalesce(own, 0)::BIGINT AS own, coalesce(corpus_mean, 0) AS corpus_mean FROM (SELECT leader, p_type AS kind, round(sum(qty)::DOUBLE / any_value(total), 4) AS corpus_mean FROM lines JOIN part ON item = p_partkey JOIN totals USING (leader) GROUP BY 1, 2) FULL JOIN (SELECT leader, p_type AS kind, sum(qty) AS own FROM decks JOIN part ON item = p_partkey GROUP BY 1, 2) USING (leader, kind)",
        "q09_mean_cost": "SELECT leader, round(CAST(sum(p_size * qty)::DOUBLE / sum(qty) AS DECIMAL(20,8)), 2)::DOUBLE AS mean_cost FROM decks JOIN part ON item = p_partkey WHERE p_type <> 'ECONOMY' GROUP BY leader",
        "q10_leader_suggestions": "SELECT item, leader, round(CAST(rate AS DECIMAL(12,4)), 2)::DOUBLE AS rate, rank FROM (SELECT item, leader, rate, row_number() OVER (PARTITION BY item ORDER BY rate DESC, leader) AS rank FROM rates WHERE (leader, item) NOT IN (SELECT leader, item FROM decks)) WHERE rank <= 3",
        "q11_leader_detection": "SELECT basket_id, leader, score, matched FROM (SELECT *, row_number() OVER (PARTITION BY basket_id ORDER BY score DESC, matched DESC, leader) AS r FROM (SELECT b.basket_id, r.leader, round(CAST(CAST(sum(CAST(rate AS DECIMAL(12,4))) AS DOUBLE) / count(*) AS DECIMAL(20,8)), 2)::DOUBLE AS score, count(*) AS matched FROM bi b JOIN rates r ON b.item = r.item GROUP BY 1, 2)) WHERE r = 1",
        "q12_best_leaders": _BEST.format("(SELECT item, 'list' AS source FROM collection)"),
        "q12_not_found": "SELECT item FROM collection WHERE item NOT IN (SELECT item FROM rates)",
        "q14_search": "SELECT i.item, i.name, i.cost, best, best_price, first, cheapest, n FROM (SELECT p_partkey AS item, p_name AS name, p_size AS cost FROM part WHERE p_name ILIKE '%RED%' ORDER BY cost NULLS LAST, name, item LIMIT 100) i LEFT JOIN (SELECT item, first(printing ORDER BY price DESC NULLS LAST, printing) AS best, max(price) AS best_price, min(printing) AS first, min(CASE WHEN price > 0 THEN price END) AS cheapest, count(*) AS n FROM printings GROUP BY item) p ON i.item = p.item",
        "q15_autocomplete": "SELECT name FROM (SELECT name, min(b) AS b FROM ((SELECT DISTINCT p_name AS name, 0 AS b FROM part WHERE p_name ILIKE 's%' ORDER BY 1 LIMIT 8) UNION ALL (SELECT DISTINCT p_name, 1 FROM part WHERE p_name ILIKE '% s%' ORDER BY 1 LIMIT 8)) GROUP BY name) ORDER BY b, name LIMIT 8",
        "q16_least_prices": "SELECT item, min(price) AS price FROM printings WHERE price > 0 AND currency = 'R' GROUP BY item",
        "q17_printings": "SELECT item, first(printing ORDER BY price DESC NULLS LAST, printing) AS best, max(price) AS best_price, min(printing) AS first, min(CASE WHEN price > 0 THEN price END) AS cheapest, count(*) AS n FROM printings GROUP BY item",
        "q18_item_source": "SELECT p_partkey AS item, CASE WHEN d.decks IS NOT NULL THEN 'in_deck' WHEN c.item IS NOT NULL THEN 'collection' WHEN o.item IS NOT NULL THEN 'opened_sets' END AS source, d.decks FROM part LEFT JOIN (SELECT item, string_agg(leader, ',' ORDER BY leader) AS decks FROM (SELECT DISTINCT leader, item FROM decks) GROUP BY item) d ON p_partkey = d.item LEFT JOIN collection c ON p_partkey = c.item LEFT JOIN opened o ON p_partkey = o.item",
        "q20_basic_counts": "SELECT leader, sum(qty)::BIGINT AS basics FROM decks JOIN part ON item = p_partkey WHERE p_type = 'ECONOMY' GROUP BY leader",
        "q22_opened": "SELECT * FROM opened",
        "q24_neighbours": "SELECT item, rank, neighbor, similarity FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY similarity DESC, neighbor) AS rank FROM (SELECT a.item, b.item AS neighbor, round(list_cosine_similarity(a.vec, b.vec), 6) AS similarity FROM vectors a JOIN vectors b ON a.item <> b.item WHERE a.item % 50 = 0)) WHERE rank <= 20",
        "q25_leader_vectors": "SELECT leader, (component - 1)::INTEGER AS component, round(CASE WHEN sum(w) <> 0 THEN sum(w * x) / sum(w) ELSE 0 END, 6) AS value FROM (SELECT leader, tfidf_norm AS w, unnest(vec) AS x, unnest(range(1, len(vec) + 1)) AS component FROM profile JOIN vectors USING (item)) GROUP BY 1, 2",
        "q33_centroid_distances": "SELECT v.item, v.cluster, round(sqrt(sum((x - m) * (x - m))), 6) AS distance FROM (SELECT item, cluster, unnest(vec) AS x, unnest(range(len(vec))) AS i FROM vectors) v JOIN (SELECT cluster, i, avg(x) AS m FROM (SELECT cluster, unnest(vec) AS x, unnest(range(len(vec))) AS i FROM vectors) GROUP BY 1, 2) c ON v.cluster = c.cluster AND v.i = c.i GROUP BY 1, 2",
        "q35_cluster_given_tag": "SELECT * FROM given",
        "q35_tag_given_cluster": "SELECT * FROM given2",
        "q35_semantics": "SELECT cluster, string_agg(tag, '|' ORDER BY r) AS tags FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY p DESC, tag) AS r FROM given2) WHERE r <= 10 GROUP BY cluster",
        "q36_additive_prediction": "SELECT * FROM additive",
        "q37_leader_prediction": "SELECT * FROM (SELECT item, leader, score, row_number() OVER (PARTITION BY item ORDER BY score DESC, leader) AS rank FROM (SELECT item, leader, round(coalesce(s / nullif(max(s) OVER (PARTITION BY item), 0), 0), 9) AS score FROM (SELECT item, leader, sum(score * mean) AS s FROM additive JOIN weights USING (cluster) GROUP BY 1, 2))) WHERE rank <= 10",
        "q38_accuracy": "SELECT count(*) AS items, round(avg(CASE WHEN r <= 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS top1, round(avg(CASE WHEN r <= 3 THEN 1.0::DOUBLE ELSE 0 END), 6) AS top3, round(avg(CASE WHEN r <= 5 THEN 1.0::DOUBLE ELSE 0 END), 6) AS top5 FROM (SELECT item, min(CASE WHEN a.cluster = v.cluster THEN rank END) AS r FROM additive a JOIN vectors v USING (item) GROUP BY item)",
        "q43_gaps": "SELECT leader, cluster, coalesce(own, 0) AS own, coalesce(weight, 0) AS meta, round(coalesce(own, 0) - coalesce(weight, 0), 6) AS delta FROM (SELECT leader, cluster, round(count(*)::DOUBLE / any_value(n), 6) AS own FROM decks JOIN vectors USING (item) JOIN (SELECT leader, count(*) AS n FROM decks GROUP BY leader) USING (leader) GROUP BY 1, 2) FULL JOIN weights USING (leader, cluster)",
        "q27_held_out": "SELECT leader, r <= ceil(n * 0.2::DOUBLE) AS held_out FROM (SELECT leader, row_number() OVER (ORDER BY md5(leader::VARCHAR), leader) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT leader FROM baskets))",
        "q30_ranking_metrics": "SELECT leader, k, round(sum(hit)::DOUBLE / k, 6) AS precision, round(sum(hit)::DOUBLE / any_value(n_rel), 6) AS recall, round(sum(hit / log2(p + 1)) / list_sum(list_transform(range(1, least(k, any_value(n_rel))::BIGINT + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg FROM (SELECT leader, p, (t <= 50)::INTEGER AS hit, sum((t <= 50)::INTEGER) OVER (PARTITION BY leader) AS n_rel FROM (SELECT leader, row_number() OVER (PARTITION BY leader ORDER BY rate DESC, item) AS t, row_number() OVER (PARTITION BY leader ORDER BY tfidf DESC, item) AS p FROM profile)) CROSS JOIN (SELECT unnest([10, 20]) AS k) WHERE p <= k GROUP BY leader, k",
        "m1_upsert": "SELECT item, printing, coalesce(np, op) AS price, coalesce(nd, od) AS day FROM (SELECT item, printing, min(price) AS op, min(day) AS od FROM printings GROUP BY 1, 2) LEFT JOIN (SELECT item, printing, first(price ORDER BY day DESC, price DESC) AS np, max(day) AS nd FROM printings WHERE currency = 'R' GROUP BY 1, 2) USING (item, printing)",
        "m2_insert_if_absent": "SELECT leader, item FROM rates UNION SELECT leader, item FROM decks",
        "m3_deck_moves": "SELECT leader, item, qty + 1 AS qty FROM decks WHERE item % 2 <> 0",
        "v1_row_counts": " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS rows, count(*) > 0 AS ok FROM {n}" for n in ("customer", "lineitem", "nation", "orders", "part", "supplier")),
        "v6_latest_prices": "SELECT item, max(day) AS day, first(price ORDER BY day DESC, price DESC) AS price FROM printings GROUP BY item",
    }.items()
}

_SCORED = """, unit AS (SELECT leader, i, sum(w * x) / sum(w) AS x FROM (SELECT leader, tfidf_norm AS w, unnest(vec) AS x, unnest(range(len(vec))) AS i FROM profile JOIN vectors USING (item)) GROUP BY 1, 2),
lv AS (SELECT leader, list(x ORDER BY i) AS lvec FROM unit GROUP BY leader),
pairs AS (SELECT leader, item FROM profile UNION SELECT leader, item FROM decks),
ts AS (SELECT leader, item, least(sum(p * weight) / any_value(nt), 1) AS tag_score FROM pairs JOIN tags USING (item) JOIN given USING (tag) JOIN weights USING (leader, cluster) JOIN (SELECT item, count(*) AS nt FROM tags GROUP BY item) USING (item) GROUP BY leader, item),
hy0 AS (SELECT p.leader, p.item, coalesce(list_cosine_similarity(v.vec, lv.lvec), 0) AS c, coalesce(f.tfidf_norm, 0) AS t, coalesce(w.weight, 0) AS w, coalesce(ts.tag_score, 0) AS g FROM pairs p LEFT JOIN profile f ON p.leader = f.leader AND p.item = f.item LEFT JOIN vectors v ON p.item = v.item LEFT JOIN lv ON p.leader = lv.leader LEFT JOIN weights w ON p.leader = w.leader AND v.cluster = w.cluster LEFT JOIN ts ON p.leader = ts.leader AND p.item = ts.item),
hy AS (SELECT leader, item, round(c, 6) + 0::DOUBLE AS cosine, round(least(0.40::DOUBLE * t + 0.25::DOUBLE * c + 0.20::DOUBLE * w + 0.15::DOUBLE * g, 1), 4) + 0::DOUBLE AS hybrid, t AS tfidf_norm, w AS weight, round(g, 6) AS tag_score FROM hy0) """

SQL["q39_hybrid"] = _sql("").rstrip() + _SCORED + "SELECT leader, item, cosine, hybrid FROM hy"
SQL["q26_features"] = _sql("").rstrip() + _SCORED + "SELECT f.leader, f.item, cosine, f.tfidf_norm, f.idf, coalesce(p_size, 0)::DOUBLE AS cost, coalesce(q.frequency, 0) AS frequency, ((p_size % 32) & ~((f.leader * 7 + 3) % 32) = 0)::INTEGER::DOUBLE AS compatible, round(ln(1 + rate), 6) AS label FROM profile f JOIN hy ON f.leader = hy.leader AND f.item = hy.item LEFT JOIN frequency q ON f.item = q.item LEFT JOIN part ON f.item = p_partkey"

_DECKS = (
    _sql("").rstrip()
    + _SCORED.rstrip()
    + """, gaps AS (SELECT leader, cluster, coalesce(own, 0) AS own, coalesce(weight, 0) AS meta, round(coalesce(own, 0) - coalesce(weight, 0), 6) AS delta FROM (SELECT leader, cluster, round(count(*)::DOUBLE / any_value(n), 6) AS own FROM decks JOIN vectors USING (item) JOIN (SELECT leader, count(*) AS n FROM decks GROUP BY leader) USING (leader) GROUP BY 1, 2) FULL JOIN weights USING (leader, cluster)),
u1 AS (SELECT leader, item, list_transform(vec, lambda x: x / sqrt(list_dot_product(vec, vec))) AS vec FROM decks JOIN vectors USING (item)),
u2 AS (SELECT leader, list(x ORDER BY i) AS mean FROM (SELECT leader, i, avg(x) AS x FROM (SELECT leader, unnest(vec) AS x, unnest(range(len(vec))) AS i FROM u1) GROUP BY 1, 2) GROUP BY leader),
dc AS (SELECT h.leader, h.item, greatest(round(list_cosine_similarity(v.vec, u2.mean), 6), 0) AS s FROM hy h JOIN vectors v ON h.item = v.item JOIN u2 ON h.leader = u2.leader),
under AS (SELECT leader, cluster, round(abs(delta) / max(abs(delta)) OVER (PARTITION BY leader), 6) AS bonus FROM gaps WHERE delta < -0.02),
adds AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY leader ORDER BY score DESC, item) AS rank FROM (SELECT h.leader, h.item, coalesce(bonus, 0) AS bonus, coalesce(dc.s, 0) AS synergy, round(0.40 * CAST(hybrid AS DECIMAL(18,4)) + 0.30 * least(0.01 * CAST(rate AS DECIMAL(18,4)), 1) + 0.20 * CAST(coalesce(bonus, 0) AS DECIMAL(18,6)) + 0.10 * CAST(coalesce(dc.s, 0) AS DECIMAL(18,6)), 4)::DOUBLE AS score FROM hy h JOIN rates r ON h.leader = r.leader AND h.item = r.item JOIN part p ON h.item = p_partkey LEFT JOIN vectors v ON h.item = v.item LEFT JOIN under u ON h.leader = u.leader AND v.cluster = u.cluster LEFT JOIN dc ON h.leader = dc.leader AND h.item = dc.item WHERE (h.leader, h.item) NOT IN (SELECT leader, item FROM decks) AND ((h.leader * 7 + 3) % 32 = 0 OR (p_size % 32) & ~((h.leader * 7 + 3) % 32) = 0))) WHERE rank <= 30),
outs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY leader ORDER BY score DESC, item) AS rank FROM (SELECT h.leader, h.item, round(0.40 * (1 - CAST(hybrid AS DECIMAL(18,4))) + 0.35 * (1 - least(5 * CAST(coalesce(meta, 0) AS DECIMAL(18,6)), 1)) + 0.25 * (1 - CAST(coalesce(dc.s, 0) AS DECIMAL(18,6))), 4)::DOUBLE AS score,
list_filter([CASE WHEN coalesce(rate, 0) = 0 THEN 'not played with this leader' WHEN rate < 5 THEN 'seldom played with this leader' END, CASE WHEN hybrid < 0.08 THEN 'low hybrid score' END, CASE WHEN coalesce(dc.s, 0) < 0.3 THEN 'little synergy with the deck' END, CASE WHEN v.cluster IS NOT NULL AND coalesce(meta, 0) < 0.01 THEN 'cluster absent from the profile' END], lambda x: x IS NOT NULL) AS why
FROM hy h JOIN decks d ON h.leader = d.leader AND h.item = d.item JOIN part p ON h.item = p_partkey LEFT JOIN rates r ON h.leader = r.leader AND h.item = r.item LEFT JOIN vectors v ON h.item = v.item LEFT JOIN gaps g ON h.leader = g.leader AND v.cluster = g.cluster LEFT JOIN dc ON h.leader = dc.leader AND h.item = dc.item WHERE p_type <> 'PROMO')) WHERE rank <= 30),
prof AS (SELECT leader, round(avg(list_cosine_similarity(vec, mean)), 6) AS coherence, round(coalesce(avg(list_cosine_similarity(vec, lvec)), 0), 6) AS similarity FROM u1 JOIN u2 USING (leader) LEFT JOIN lv USING (leader) GROUP BY leader) """
)
SQL["q42_deck_profile"] = _DECKS + "SELECT * FROM prof"
SQL["q44_deck_additions"] = _DECKS + "SELECT * FROM adds"
SQL["q45_deck_cuts"] = _DECKS + "SELECT leader, rank, item, score, CASE WHEN len(why) = 0 THEN 'less suited on the whole' ELSE array_to_string(why, '|') END AS reasons FROM outs"
SQL["q46_replacements"] = _DECKS + "SELECT o.leader, o.rank, o.item AS cut, a.item AS added, round((CAST(a.score AS DECIMAL(18,4)) - (1 - CAST(o.score AS DECIMAL(18,4)))) * 100, 1)::DOUBLE AS gain, CASE WHEN len(why) = 0 THEN 'less suited on the whole' ELSE array_to_string(why[1:2], ' | ') END AS reasons FROM outs o JOIN adds a ON o.leader = a.leader AND o.rank = a.rank"
SQL["q47_global_score"] = _DECKS + "SELECT leader, round(d, 6) AS distance, round(0.40::DOUBLE * coherence + 0.35::DOUBLE * similarity + 0.25::DOUBLE * greatest(0, 1 - d), 4) AS score FROM prof JOIN (SELECT leader, sqrt(sum(delta * delta)) AS d FROM gaps GROUP BY leader) USING (leader)"
SQL["q36_bayes_prediction"] = _sql(
    """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY p DESC, cluster) AS rank FROM (SELECT item, cluster, round(exp(l - max(l) OVER (PARTITION BY item)) / sum(exp(l - m)) OVER (PARTITION BY item), 6) AS p FROM (SELECT *, max(l) OVER (PARTITION BY item) AS m FROM (
    SELECT t.item, c.cluster, any_value(ln(c.docs::DOUBLE / (SELECT count(DISTINCT (item, cluster)) FROM tagged))) + sum(ln((coalesce(s.m, 0) + 0.5::DOUBLE) / (c.n + 0.5::DOUBLE * (SELECT count(DISTINCT tag) FROM tagged)))) AS l
    FROM (SELECT * FROM tags WHERE tag IN (SELECT tag FROM tagged)) t CROSS JOIN (SELECT cluster, count(*) AS n, count(DISTINCT item) AS docs FROM tagged GROUP BY cluster) c LEFT JOIN (SELECT tag, cluster, count(*) AS m FROM tagged GROUP BY 1, 2) s ON s.tag = t.tag AND s.cluster = c.cluster GROUP BY 1, 2)))) WHERE rank <= 5"""
)
