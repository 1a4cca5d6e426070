"""More registered queries: lookups, names, explanations, clusters, checks and models; and DuckDB SQL for them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import advisor, catalogue, clusters, grams, hybrid, index, insight, ml, popularity, shapley, stats, tags
from ..sources.driver_tables import BASIC
from .queries import SQL as _FIRST
from .queries import _DECKS, _SCORED, FEATURES, Derived, _features, _q, _sql, _trained

#: Tags that name a family of clusters, types in the order in which they are looked for, and reference names (fixed values of the queries).
FAMILIES = ["red", "blue", "hot", "cold", "widget"]
TYPES = ["PROMO", "RED", "SMALL", "BLUE", "ECONOMY"]
REFERENCES = ["red widget", "blue bolt", "hot gear", "cold anvil", "new ring", "old rod", "small plate", "large gizmo", "no such name", "red gear"]


def _lines_of_type(t: Derived):
    return t.items().select("item", F.concat_ws(" // ", "kind", "name").alias("line"), F.regexp_replace("name", " ", " // ").alias("name"), "cost")


def _typed(t: Derived):
    return _lines_of_type(t).select("item", "name", advisor.first_type(F.col("line"), TYPES).alias("type"), "cost")


def _faces(t: Derived):
    return t.items().select("item", F.col("kind").alias("line"), F.when(F.col("cost") % 3 != 0, F.col("cost")).alias("mana_cost"))


def _partners(t: Derived):
    n = t.nations()
    pairs = n.select("leader", "name").join(n.select((F.col("leader") - 1).alias("leader"), F.col("name").alias("next")), "leader")
    return pairs.select(F.concat_ws(" + ", "name", "next").alias("name")).unionByName(n.select("name"))


def _totals(t: Derived):
    per = t.baskets().groupBy("leader").agg(F.count("*").alias("total"))
    return t.nations().join(per, "leader").select(F.col("name").alias("leader"), "total")


def _stems(t: Derived):
    region = t.read("region").select(F.col("r_regionkey").alias("region"), "r_name")
    return t.nations().join(region, "region").where("leader % 2 = 0").select(F.concat_ws(" deck of ", "r_name", "name").alias("stem"))


def _wanted_names(t: Derived):
    region = t.read("region").select(F.col("r_regionkey").alias("region"), "r_name")
    return t.nations().join(region, "region").select(F.concat_ws(" ", "name", "r_name").alias("name")).unionByName(t.nations().select("name"))


def _members(t: Derived):
    return clusters.members(t.vectors(), t.frequency())


def _families(t: Derived):
    return clusters.families(tags.tag_given_cluster(t.tagged()), FAMILIES)


def _predictions(t: Derived):
    return {
        "additive": tags.additive_prediction(t.tags(), t.given()),
        "bayes": tags.bayes_prediction(t.tags(), t.tagged()),
        "cosine": tags.cosine_prediction(t.tags(), tags.tag_given_cluster(t.tagged())),
    }


def _unseen(t: Derived):
    new = t.tags().join(t.vectors().select("item"), "item", "left_anti")
    return insight.unseen_items(tags.bayes_prediction(new, t.tagged()), t.weights(), t.vectors(), t.frequency())


def _unknown(t: Derived):
    """mine, with leaders under 5 unknown to the rates."""
    return popularity.additions_or_fallback(t.mine(), t.rates().where("leader >= 5"), t.basket_items())


def _importance(t: Derived):
    model, _ = _trained(t)
    return ml.importances(model, FEATURES, t.spark)


def _two_models(t: Derived):
    """name: (model, predictions, features) of the model without the cosine and of that with it."""
    rows = t.stored(_features(t), "features")
    split = ml.held_out(rows, "leader")
    return {name: (*ml.rate_model(rows, split, columns), columns) for name, columns in (("baseline", FEATURES[1:]), ("full", FEATURES))}


def _union(parts: dict):
    """The tables of a dictionary, with its keys as column `model`."""
    return reduce(lambda a, b: a.unionByName(b), (df.withColumn("model", F.lit(name)) for name, df in parts.items()))


def _shap(t: Derived):
    return _union({name: shapley.mean_contributions(shapley.explained(guess, model, columns), columns) for name, (model, guess, columns) in _two_models(t).items()})


def _shap_cosine(t: Derived):
    model, guess = _trained(t)
    return shapley.feature_effect(shapley.explained(guess, model, FEATURES), FEATURES, "cosine")


def _asked_vectors(t: Derived):
    return t.vectors().where("item % 50 = 0")


def _indexed_autocomplete(t: Derived):
    index = grams.built(t.items().select("item", "name"))
    return catalogue.autocomplete([index.starting("s"), index.containing(" s")], 8)


def _runs(t: Derived):
    return t.read("orders").select(F.col("o_orderkey").alias("run"), F.col("o_orderstatus").alias("status"))


def _config(t: Derived):
    entry = t.nations().select(F.col("leader").alias("deck_id"), F.concat(F.lit("deck/"), F.col("leader")).alias("url"), "leader", "name")
    fresh = entry.where("leader % 4 = 0").withColumn("name", F.concat("name", F.lit(" again")))
    return catalogue.configured(entry.where("leader < 20"), fresh, entry.where("leader % 5 = 0"))


def _documents(t: Derived):
    return t.read("documents").select("doc_id", advisor.shortened(F.col("text")).alias("text"))


QUERIES = {
    "q03_profiles": _q(lambda t: stats.signatures(t.profile(), 500)),
    "q04_additions_or_fallback": _q(_unknown, True),
    "q05_pairwise_support": _q(lambda t: popularity.pairwise_support(t.decks().select(F.col("leader").alias("owner"), "item"), t.basket_items()), True),
    "q06_counters": _q(lambda t: advisor.counters(t.collection(), advisor.available(t.collection(), t.decks(), t.opened()), t.decks()), True),
    "q07_without_data": _q(lambda t: advisor.without_data(t.decks(), t.rates().where("leader % 3 <> 0"))),
    "m4_deck_config": _q(_config),
    "q09_kinds_of_decks": _q(lambda t: advisor.deck_means_of_kind(t.lines(), t.items(), t.baskets())),
    "q09_mean_cost_of_decks": _q(lambda t: advisor.mean_cost_of_decks(t.lines(), t.items(), t.baskets(), BASIC)),
    "q13_rate_lookup": _q(lambda t: advisor.rate_of(t.decks(), t.rates())),
    "q14_indexed_search": _q(lambda t: catalogue.indexed_search(grams.built(t.items().select("item", "name")), t.items(), t.printings(), "red", 100)),
    "q15_indexed_autocomplete": _q(_indexed_autocomplete),
    "q14_search_images": _q(lambda t: catalogue.searched(t.items(), t.printings(), "%BLUE%", 100)),
    "q19_decks_with": _q(lambda t: advisor.decks_with(t.decks())),
    "q21_deck_list": _q(lambda t: advisor.deck_list(t.nations().where("region = 2").select("name"), t.nations().select(F.lower("name").alias("name")))),
    "q29_described_rates": _q(lambda t: ml.described(t.rates(), "leader", "rate")),
    "q33_cluster_summary": _q(lambda t: clusters.described(_members(t))),
    "q33_most_frequent": _q(lambda t: clusters.most_frequent(_members(t))),
    "q33_similarities": _q(lambda t: clusters.similarities(t.vectors())),
    "q34_taxonomy": _q(lambda t: clusters.taxonomy(_families(t), clusters.summary(_members(t)))),
    "q35_discriminant": _q(lambda t: tags.discriminant(t.given(), 0.1)),
    "q36_cosine_prediction": _q(lambda t: tags.cosine_prediction(t.tags(), tags.tag_given_cluster(t.tagged()))),
    "q38_accuracy_by_cluster": _q(lambda t: tags.accuracy_by_cluster(_predictions(t), t.vectors(), tags.eligible(t.tagged(), 2))),
    "q38_profiles": _q(lambda t: tags.profiles(t.tagged(), _families(t))),
    "q41_unseen_items": _q(_unseen, True),
    "q42_kinds_of_deck": _q(lambda t: hybrid.shares(t.decks(), t.items(), "cost")),
    "q42_tags_of_deck": _q(lambda t: hybrid.shares(t.decks(), t.tags(), "tag")),
    "q42_colours_of_deck": _q(lambda t: hybrid.shares(t.decks(), t.item_colours().select("item", F.explode("colours").alias("colour")), "colour")),
    "q43_gap_states": _q(lambda t: hybrid.gap_states(t.gaps()), True),
    "q48_explanations": _q(lambda t: insight.explanations(t.hybrids(), t.rates()), True),
    "q49_batch": _q(lambda t: insight.batch(t.hybrids(), t.collection()), True),
    "q49_separation": _q(lambda t: insight.separation(t.hybrids(), t.vectors(), t.weights()), True),
    "q50_partner_rates": _q(lambda t: advisor.partner_rates(_partners(t), _totals(t))),
    "q51_deck_files": _q(lambda t: advisor.matched_files(_wanted_names(t), _stems(t))),
    "q52_item_types": _q(lambda t: _typed(t).select("item", "type")),
    "q53_face_names": _q(lambda t: advisor.face_names(_typed(t))),
    "q54_face_lands": _q(lambda t: advisor.face_lands(_lines_of_type(t), _faces(t), "small")),
    "q55_rate_labels": _q(lambda t: advisor.labelled_rates(t.rates())),
    "q56_shortened": _q(_documents),
    "v2_legal_share": _q(lambda t: catalogue.share_of(t.items(), "legal", F.col("kind") != BASIC)),
    "v3_with_printing": _q(lambda t: catalogue.covered(t.items(), t.printings(), "item")),
    "v4_priced_printings": _q(lambda t: catalogue.priced(t.printings())),
    "v5_last_run": _q(lambda t: catalogue.last_run(_runs(t), "F")),
    "v6_references": _q(lambda t: catalogue.references(t.items(), REFERENCES, t.printings())),
    "v7_tag_inventory": _q(lambda t: catalogue.tag_inventory(t.items(), t.tags())),
    "v8_empty_counts": _q(lambda t: ml.empty_counts(_features(t), [*FEATURES, "label"]), True),
    "q23_item_vectors": _q(lambda t: ml.item_vectors(t.lines())),
    "q29_errors": _q(lambda t: ml.error_scales(_trained(t)[1]), True),
    "q29_errors_by_cosine": _q(lambda t: ml.errors_by_tercile(_trained(t)[1], "cosine"), True),
    "q29_importances": _q(_importance, True),
    "q24_indexed_neighbours": _q(lambda t: index.built(t.vectors()).search(_asked_vectors(t))),
    "q24_index_recall": _q(lambda t: index.recall_of(index.built(t.vectors()), _asked_vectors(t))),
    "q28_models": _q(lambda t: _union({name: ml.error_scales(guess) for name, (_, guess, _) in _two_models(t).items()}), True),
    "q29_contributions": _q(_shap, True),
    "q29_contributions_of_cosine": _q(_shap_cosine, True),
    "q30_ranking_by_models": _q(lambda t: _union({name: ml.ranking_metrics(guess, "label", "prediction") for name, (_, guess, _) in _two_models(t).items()}), True),
}


_TYPE = "CASE " + " ".join(f"WHEN contains(lower(p_type || ' // ' || p_name), '{x.lower()}') THEN '{x}'" for x in TYPES) + " END"
_MEMBERS = """mem AS (SELECT d.item, d.cluster, coalesce(f.frequency, 0) AS frequency, coalesce(f.idf, 0) AS idf, distance FROM (SELECT v.item, v.cluster, round(sqrt(sum((x - m) * (x - m))), 6) AS distance FROM (SELECT item, cluster, unnest(vec) AS x, unnest(range(len(vec))) AS i FROM vectors WHERE cluster <> -1) v JOIN (SELECT cluster, i, avg(x) AS m FROM (SELECT cluster, unnest(vec) AS x, unnest(range(len(vec))) AS i FROM vectors) GROUP BY 1, 2) c ON v.cluster = c.cluster AND v.i = c.i GROUP BY 1, 2) d LEFT JOIN frequency f ON d.item = f.item),
byf AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY frequency DESC, item) AS rf, row_number() OVER (PARTITION BY cluster ORDER BY distance, item) AS rd FROM mem)"""
_MEAN = "round(CAST(CAST(sum(CAST({0} AS DECIMAL(18,6))) AS DOUBLE) / count(*) AS DECIMAL(20,8)), 4)::DOUBLE AS mean_{0}"
_SUMMARY = f"SELECT row_number() OVER (ORDER BY count(*) DESC, cluster) AS rank, cluster, count(*) AS size, {_MEAN.format('frequency')}, {_MEAN.format('idf')}, {_MEAN.format('distance')}, max(CASE WHEN rf = 1 THEN item END) AS top_item, max(CASE WHEN rd = 1 THEN item END) AS representative, string_agg(item, '|' ORDER BY rf) FILTER (rf <= 5) AS top_items, string_agg(item, '|' ORDER BY rd) FILTER (rd <= 20) AS nearest FROM byf GROUP BY cluster"
_FAMILIES = f"fam AS (SELECT cluster, CASE WHEN tag IN ({', '.join(repr(x) for x in FAMILIES)}) THEN tag ELSE 'other' END AS family, p AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY p DESC, tag) AS r FROM given2) WHERE r = 1)"
_BAYES = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY p DESC, cluster) AS rank FROM (SELECT item, cluster, round(exp(l - m) / sum(exp(l - m)) OVER (PARTITION BY item), 6) AS p FROM (SELECT *, max(l) OVER (PARTITION BY item) AS m FROM (
SELECT t.item, c.cluster, any_value(ln(c.docs::DOUBLE / (SELECT count(DISTINCT (item, cluster)) FROM tagged))) + sum(ln((coalesce(s.m, 0) + 0.5::DOUBLE) / (c.n + 0.5::DOUBLE * (SELECT count(DISTINCT tag) FROM tagged)))) AS l
FROM (SELECT * FROM tags WHERE tag IN (SELECT tag FROM tagged)) t CROSS JOIN (SELECT cluster, count(*) AS n, count(DISTINCT item) AS docs FROM tagged GROUP BY cluster) c LEFT JOIN (SELECT tag, cluster, count(*) AS m FROM tagged GROUP BY 1, 2) s ON s.tag = t.tag AND s.cluster = c.cluster GROUP BY 1, 2)))) WHERE rank <= 5"""
_COSINE = """cdoc AS (SELECT cluster, tag, greatest(1, floor(10 * p)) AS tf FROM given2),
cidf AS (SELECT tag, ln((1 + (SELECT count(DISTINCT cluster) FROM cdoc))::DOUBLE / (1 + count(*))) + 1 AS idf FROM cdoc GROUP BY tag),
cd AS (SELECT cluster, tag, tf * idf AS d FROM cdoc JOIN cidf USING (tag)),
cq AS (SELECT item, tag, count(*) * any_value(idf) AS q FROM tags JOIN cidf USING (tag) GROUP BY 1, 2),
cosp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, cluster) AS rank FROM (SELECT item, cluster, round(sum(q * d) / (any_value(qn) * any_value(dn)), 6) AS score FROM cq JOIN cd USING (tag) JOIN (SELECT item, sqrt(sum(q * q)) AS qn FROM cq GROUP BY 1) USING (item) JOIN (SELECT cluster, sqrt(sum(d * d)) AS dn FROM cd GROUP BY 1) USING (cluster) GROUP BY 1, 2) WHERE score > 0) WHERE rank <= 5)"""
_COOC = "co AS (SELECT a.item, b.item AS other, count(*) AS n FROM bi a JOIN bi b USING (basket_id) WHERE a.item <> b.item GROUP BY 1, 2)"


def _more(body: str, *ctes: str) -> str:
    return ", ".join([_sql("").rstrip(), *ctes]) + " " + body


def _scored(body: str) -> str:
    return _sql("").rstrip() + _SCORED + body


_MEAN_IN = "round(CAST(CAST(sum(CASE WHEN {0} THEN CAST(hybrid AS DECIMAL(18,4)) END) AS DOUBLE) / count(*) FILTER ({0}) AS DECIMAL(20,8)), 6)"

SQL = {
    "q03_profiles": _more("SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY leader ORDER BY tfidf DESC, item) AS rank FROM profile) WHERE rank <= 500"),
    "q04_additions_or_fallback": _more(
        "SELECT owner, rank, item, score, 'leader' AS way FROM adds WHERE owner IN (SELECT owner FROM known) UNION ALL SELECT owner, rank, item, score, 'together' FROM (SELECT s.owner, row_number() OVER (PARTITION BY s.owner ORDER BY score DESC, s.item) AS rank, s.item, score FROM (SELECT owner, other AS item, sum(n)::BIGINT AS score FROM (SELECT DISTINCT owner, item FROM mine WHERE owner NOT IN (SELECT owner FROM known)) JOIN co USING (item) GROUP BY 1, 2) s LEFT JOIN (SELECT DISTINCT owner, item FROM mine) m ON s.owner = m.owner AND s.item = m.item WHERE m.item IS NULL) WHERE rank <= 20",
        _COOC,
        "adds AS (SELECT * FROM (SELECT owner, row_number() OVER (PARTITION BY owner ORDER BY n DESC, r.item) AS rank, r.item, n AS score FROM (SELECT DISTINCT owner, leader FROM mine WHERE leader >= 5) o JOIN rates r USING (leader) WHERE NOT EXISTS (FROM mine m WHERE m.owner = o.owner AND m.item = r.item)) WHERE rank <= 20)",
        "known AS (SELECT owner FROM adds GROUP BY owner HAVING count(*) >= 20)",
    ),
    "q05_pairwise_support": _more("SELECT * FROM (SELECT leader AS owner, row_number() OVER (PARTITION BY leader ORDER BY support, item) AS rank, item, support FROM (SELECT d.leader, d.item, coalesce(sum(co.n) FILTER (o.item IS NOT NULL), 0)::BIGINT AS support FROM decks d LEFT JOIN co ON d.item = co.item LEFT JOIN decks o ON d.leader = o.leader AND co.other = o.item GROUP BY 1, 2)) WHERE rank <= 20", _COOC),
    "q06_counters": _more("SELECT 'collection' AS name, count(*) AS n FROM collection UNION ALL SELECT 'free of collection', count(*) FROM avail UNION ALL SELECT 'free of opened', count(*) FROM candidates WHERE source = 'opened' UNION ALL SELECT 'leaders', count(DISTINCT leader) FROM decks"),
    "q07_without_data": _more("SELECT DISTINCT leader FROM decks WHERE leader NOT IN (SELECT leader FROM rates WHERE leader % 3 <> 0)"),
    "m4_deck_config": "SELECT n_nationkey AS deck_id, 'deck/' || n_nationkey AS url, n_nationkey AS leader, CASE WHEN n_nationkey % 4 = 0 THEN n_name || ' again' ELSE n_name END AS name FROM nation WHERE (n_nationkey < 20 OR n_nationkey % 4 = 0) AND n_nationkey % 5 <> 0",
    "q09_kinds_of_decks": _more("SELECT leader, kind, round(CAST(s::DOUBLE / total AS DECIMAL(20,8)), 1)::DOUBLE AS mean FROM (SELECT leader, p_type AS kind, sum(qty) AS s FROM lines JOIN part ON item = p_partkey GROUP BY 1, 2) JOIN totals USING (leader)"),
    "q09_mean_cost_of_decks": _more("SELECT leader, round(CAST(sum(c)::DOUBLE / any_value(total) AS DECIMAL(20,8)), 2)::DOUBLE AS mean_cost FROM (SELECT leader, basket_id, round(CAST(sum(p_size * qty)::DOUBLE / sum(qty) AS DECIMAL(20,8)), 2) AS c FROM lines JOIN part ON item = p_partkey WHERE p_type <> 'ECONOMY' GROUP BY 1, 2) JOIN totals USING (leader) GROUP BY leader"),
    "q13_rate_lookup": _more("SELECT d.leader, d.item, round(CAST(rate AS DECIMAL(12,4)), 1)::DOUBLE AS rate, n, total FROM decks d LEFT JOIN rates r ON d.leader = r.leader AND d.item = r.item"),
    "q14_search_images": _more("SELECT i.item, name, cost, coalesce(dear, first) AS image, price FROM (SELECT p_partkey AS item, p_name AS name, p_size AS cost FROM part WHERE p_name ILIKE '%BLUE%' ORDER BY cost NULLS LAST, name, item LIMIT 100) i LEFT JOIN (SELECT item, first(printing ORDER BY price DESC, printing) FILTER (price IS NOT NULL) AS dear, min(printing) AS first, min(price) FILTER (price > 0) AS price FROM printings GROUP BY item) p ON i.item = p.item"),
    "q19_decks_with": _more("SELECT item, string_agg(leader, ',' ORDER BY leader) AS decks FROM (SELECT DISTINCT leader, item FROM decks) GROUP BY item"),
    "q21_deck_list": "SELECT row_number() OVER (ORDER BY lower(name), name, source) AS rank, name, source FROM (SELECT n_name AS name, 'configured' AS source FROM nation WHERE n_regionkey = 2 UNION ALL SELECT lower(n_name), 'local' FROM nation WHERE n_regionkey <> 2)",
    "q29_described_rates": _more("SELECT leader, count(rate) AS n, round(avg(rate), 6) AS mean, round(median(rate), 6) AS median, round(stddev_samp(rate), 6) AS std, min(rate) AS least, max(rate) AS most, round(quantile_cont(rate, 0.25), 6) AS q1, round(quantile_cont(rate, 0.75), 6) AS q3 FROM rates GROUP BY leader"),
    "q33_cluster_summary": _more(_SUMMARY, _MEMBERS),
    "q33_most_frequent": _more("SELECT cluster, size, items FROM (SELECT cluster, count(*) AS size, string_agg(item, '|' ORDER BY rf) FILTER (rf <= 50) AS items FROM byf GROUP BY cluster ORDER BY size DESC, cluster LIMIT 50)", _MEMBERS),
    "q33_similarities": _more("SELECT a.cluster AS a, b.cluster AS b, round(list_cosine_similarity(a.v, b.v), 6) AS similarity FROM cen a JOIN cen b ON a.cluster < b.cluster", "cen AS (SELECT cluster, list(m ORDER BY i) AS v FROM (SELECT cluster, i, avg(x) AS m FROM (SELECT cluster, unnest(vec) AS x, unnest(range(len(vec))) AS i FROM vectors WHERE cluster <> -1) GROUP BY 1, 2) GROUP BY cluster)"),
    "q34_taxonomy": _more("SELECT family, count(*) AS clusters, sum(coalesce(size, 0))::BIGINT AS items, round(CAST(CAST(sum(CAST(confidence AS DECIMAL(18,4))) AS DOUBLE) / count(*) AS DECIMAL(20,8)), 3)::DOUBLE AS mean_confidence, string_agg(cluster, '|' ORDER BY coalesce(size, 0) DESC, cluster) AS members FROM fam LEFT JOIN (SELECT cluster, count(*) AS size FROM vectors WHERE cluster <> -1 GROUP BY cluster) USING (cluster) GROUP BY family", _FAMILIES),
    "q35_discriminant": _more("SELECT row_number() OVER (ORDER BY most DESC, tag) AS rank, tag, clusters, most FROM (SELECT tag, count(*) FILTER (p > 0.1) AS clusters, max(p) AS most FROM given GROUP BY tag) WHERE most > 0.1 ORDER BY rank LIMIT 20"),
    "q36_cosine_prediction": _more("SELECT item, rank, cluster, score FROM cosp", _COSINE),
    "q38_accuracy_by_cluster": _more(
        " UNION ALL ".join(f"SELECT '{m}' AS method, cluster, count(*) AS items, round(avg(CASE WHEN r <= 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS top1, round(avg(CASE WHEN r <= 3 THEN 1.0::DOUBLE ELSE 0 END), 6) AS top3, round(avg(CASE WHEN r <= 5 THEN 1.0::DOUBLE ELSE 0 END), 6) AS top5 FROM (SELECT v.item, v.cluster, min(CASE WHEN p.cluster = v.cluster THEN rank END) AS r FROM vectors v JOIN chosen USING (item) LEFT JOIN {p} p ON v.item = p.item GROUP BY 1, 2) GROUP BY cluster" for m, p in (("additive", "additive"), ("bayes", "bayes"), ("cosine", "cosp"))),
        _COSINE,
        f"bayes AS ({_BAYES})",
        "chosen AS (SELECT item FROM tagged GROUP BY item HAVING count(*) >= 2 ORDER BY md5('42:' || item), item LIMIT 500)",
    ),
    "q38_profiles": _more("SELECT item, cluster, coalesce(family, '') AS family, tags FROM (SELECT item, min(cluster) AS cluster, array_to_string(list_sort(list(tag))[1:5], '|') AS tags FROM tagged GROUP BY item) LEFT JOIN fam USING (cluster)", _FAMILIES),
    "q41_unseen_items": _more(
        "SELECT s.item, rank, leader, probability, t.cluster, confidence, coalesce(popularity, 0) AS popularity FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY s DESC, leader) AS rank, round(coalesce(s / nullif(max(s) OVER (PARTITION BY item), 0), 0), 4) AS probability FROM (SELECT item, leader, CAST(sum(CAST(p AS DECIMAL(18,6)) * CAST(weight AS DECIMAL(18,6))) AS DOUBLE) AS s FROM bayes JOIN weights USING (cluster) GROUP BY 1, 2)) s JOIN (SELECT item, cluster, round(p, 4) AS confidence FROM bayes WHERE rank = 1) t ON s.item = t.item LEFT JOIN (SELECT cluster, round(CAST(CAST(sum(CAST(frequency AS DECIMAL(18,4))) AS DOUBLE) / count(*) AS DECIMAL(20,8)), 2)::DOUBLE AS popularity FROM vectors JOIN frequency USING (item) GROUP BY cluster) k ON t.cluster = k.cluster WHERE rank <= 10",
        f"bayes AS (SELECT * FROM ({_BAYES}) WHERE p > 0.01 AND item NOT IN (SELECT item FROM vectors))",
    ),
    "q42_kinds_of_deck": _more("SELECT leader, p_size AS cost, count(*) AS n, round(count(*)::DOUBLE / any_value(lines), 4) AS share FROM decks JOIN part ON item = p_partkey JOIN (SELECT leader, count(*) AS lines FROM decks GROUP BY leader) USING (leader) GROUP BY 1, 2"),
    "q42_tags_of_deck": _more("SELECT leader, tag, count(*) AS n, round(count(*)::DOUBLE / any_value(lines), 4) AS share FROM decks JOIN tags USING (item) JOIN (SELECT leader, count(*) AS lines FROM decks GROUP BY leader) USING (leader) GROUP BY 1, 2"),
    "q42_colours_of_deck": _more("SELECT leader, colour, count(*) AS n, round(count(*)::DOUBLE / any_value(lines), 4) AS share FROM decks JOIN (SELECT p_partkey AS item, b::INTEGER AS colour FROM part, range(5) r(b) WHERE (p_size >> b::INTEGER) % 2 = 1) USING (item) JOIN (SELECT leader, count(*) AS lines FROM decks GROUP BY leader) USING (leader) GROUP BY 1, 2"),
    "q43_gap_states": _DECKS + "SELECT *, CASE WHEN delta < -0.02 THEN 'under' WHEN delta > 0.02 THEN 'over' ELSE 'even' END AS state, abs(delta) > 0.015 AS shown, own = 0 AND meta > 0.05 AS missing FROM gaps",
    "q48_explanations": _scored("SELECT h.leader, h.item, hybrid, coalesce(rate, 0) AS rate, coalesce(concat_ws('|', CASE WHEN tfidf_norm > 0.6 THEN 'characteristic of the leader' WHEN tfidf_norm > 0 THEN 'played with the leader' END, CASE WHEN cosine > 0.5 THEN 'close to the leader' WHEN cosine > 0.2 THEN 'near to the leader' END, CASE WHEN weight > 0 THEN 'in a cluster of the leader' END, CASE WHEN tag_score > 0.1 THEN 'tags suit the leader' END), '') AS reasons, coalesce(concat_ws('|', CASE WHEN tfidf_norm = 0 THEN 'no history with the leader' END, CASE WHEN weight > 0 AND weight < 0.05 THEN 'cluster is rare with the leader' END), '') AS caveats FROM hy h LEFT JOIN rates r ON h.leader = r.leader AND h.item = r.item"),
    "q49_batch": _scored("SELECT * FROM (SELECT leader, row_number() OVER (PARTITION BY leader ORDER BY hybrid DESC, item) AS rank, item, hybrid FROM hy WHERE item IN (SELECT item FROM collection)) WHERE rank <= 50"),
    "q49_separation": _scored(f"SELECT leader, a::DOUBLE AS in_theme, b::DOUBLE AS off_theme, (a - b)::DOUBLE AS separation FROM (SELECT leader, {_MEAN_IN.format('cluster = main')} AS a, {_MEAN_IN.format('cluster <> main')} AS b FROM hy JOIN vectors USING (item) JOIN (SELECT leader, first(cluster ORDER BY weight DESC, cluster) AS main FROM weights GROUP BY leader) USING (leader) GROUP BY leader) WHERE a IS NOT NULL AND b IS NOT NULL"),
    "q50_partner_rates": _more("SELECT name, first(leader ORDER BY total DESC, place) AS leader, max(total) AS total FROM (SELECT name, unnest([name, trim(string_split(name, '+')[1]), trim(string_split(name, '+')[2])]) AS leader, unnest([0, 1, 2]) AS place FROM (SELECT a.n_name || ' + ' || b.n_name AS name FROM nation a JOIN nation b ON b.n_nationkey = a.n_nationkey + 1 UNION ALL SELECT n_name FROM nation)) p JOIN (SELECT n_name AS leader, total FROM totals JOIN nation ON leader = n_nationkey) USING (leader) GROUP BY name"),
    "q51_deck_files": r"""WITH f AS (SELECT r_name || ' deck of ' || n_name AS stem FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 2 = 0), w AS (SELECT n_name || ' ' || r_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT n_name FROM nation),
        g AS (SELECT stem, regexp_replace(lower(stem), '[^a-z0-9 ]', ' ', 'g') AS s FROM f), n AS (SELECT name, trim(regexp_replace(lower(name), '[^a-z0-9 ]', ' ', 'g')) AS n FROM w), l AS (SELECT *, list_filter(regexp_split_to_array(n, ' +'), lambda x: length(x) >= 4) AS ws FROM n),
        j AS (SELECT name, stem, CASE WHEN contains(s, n) THEN 1 WHEN len(ws) > 0 AND list_bool_and(list_transform(ws, lambda x: contains(s, x))) THEN 2 WHEN len(ws) > 0 AND contains(s, ws[1]) THEN 3 END AS pass FROM l CROSS JOIN g)
        SELECT name, first(stem ORDER BY pass, stem) AS stem, min(pass) AS pass FROM j WHERE pass IS NOT NULL GROUP BY name""",
    "q52_item_types": f"SELECT p_partkey AS item, {_TYPE} AS type FROM part",
    "q53_face_names": f"WITH k AS (SELECT p_partkey AS item, replace(p_name, ' ', ' // ') AS name, {_TYPE} AS type, p_size AS cost FROM part) SELECT name, first(type ORDER BY p, item) AS type, first(cost ORDER BY p, item) AS cost FROM (SELECT name, 0 AS p, item, type, cost FROM k WHERE type IS NOT NULL UNION ALL SELECT trim(string_split(name, '//')[1]), 1, item, type, cost FROM k WHERE type IS NOT NULL AND contains(name, '//')) GROUP BY name",
    "q54_face_lands": "WITH k AS (SELECT replace(p_name, ' ', ' // ') AS name FROM part WHERE (p_size % 3 = 0 AND p_type ILIKE '%small%') OR p_type || ' // ' || p_name ILIKE '% // %small%') SELECT name FROM k UNION SELECT trim(string_split(name, '//')[1]) FROM k",
    "q55_rate_labels": _more("SELECT leader, item, rate, CASE WHEN rate < 20 THEN 'low' WHEN rate < 40 THEN 'fair' WHEN rate < 60 THEN 'good' ELSE 'high' END AS label, CASE WHEN rate > 70 THEN 'strong' WHEN rate > 50 THEN 'medium' ELSE 'weak' END AS badge FROM rates"),
    "q56_shortened": "SELECT doc_id, CASE WHEN length(text) > 280 THEN substr(text, 1, 280) || '…' ELSE text END AS text FROM documents",
    "v2_legal_share": "SELECT 'legal' AS name, count(*) AS rows, count(*) FILTER (p_type <> 'ECONOMY') AS holding, round(CAST(100 * count(*) FILTER (p_type <> 'ECONOMY')::DOUBLE / count(*) AS DECIMAL(20,8)), 1)::DOUBLE AS percent, count(*) FILTER (p_type <> 'ECONOMY') > 0 AS ok FROM part",
    "v3_with_printing": "SELECT count(*) AS items, count(*) FILTER (p_partkey IN (SELECT l_partkey FROM lineitem)) AS covered, count(*) FILTER (p_partkey NOT IN (SELECT l_partkey FROM lineitem)) AS bare FROM part",
    "v4_priced_printings": _more("SELECT currency, count(DISTINCT (item, printing)) AS printings FROM printings WHERE price IS NOT NULL GROUP BY currency"),
    "v5_last_run": "SELECT o_orderkey AS run, o_orderstatus AS status, o_orderstatus = 'F' AS ok FROM orders ORDER BY o_orderkey DESC LIMIT 1",
    "v6_references": _more("SELECT w.name, p.item, day, price, p.item IS NOT NULL AS ok FROM (SELECT unnest([" + ", ".join(f"'{x}'" for x in REFERENCES) + "]) AS name) w LEFT JOIN (SELECT p_name AS name, min(p_partkey) AS item FROM part GROUP BY 1) p ON w.name = p.name LEFT JOIN (SELECT item, max(day) AS day, first(price ORDER BY day DESC, price DESC) AS price FROM printings GROUP BY item) l ON p.item = l.item"),
    "v7_tag_inventory": _more("SELECT row_number() OVER (ORDER BY items DESC, tag) AS rank, tag, items, round(CAST((SELECT count(DISTINCT item) FROM tags)::DOUBLE / (SELECT count(*) FROM part) AS DECIMAL(20,8)), 4)::DOUBLE AS coverage FROM (SELECT tag, count(DISTINCT item) AS items FROM tags GROUP BY tag) ORDER BY rank LIMIT 20"),
    "v8_empty_counts": "SELECT unnest([" + ", ".join(f"'{x}'" for x in (*FEATURES, "label")) + "]) AS feature, 0::BIGINT AS empty",
    "q14_indexed_search": _FIRST["q14_search"],
    "q15_indexed_autocomplete": _FIRST["q15_autocomplete"],
}
