"""TF-IDF vectors, multinomial naive Bayes, metrics and cross-validation, all over tables with a `fold` key.

Every operator takes the folds of all its inputs at once: a cross-validation is one plan, not a loop. Without folds the
key is 0 throughout.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexframe.functions import lexicon as lx
from lexframe.functions.textcols import ngrams, word_tokens


#: Parts in which a vocabulary is ranked before all of it is.
RANK_PARTS = 64


@dataclass(frozen=True)
class Params:
    """Of the vectors and the classifier."""

    max_features: int = 5000
    min_df: int = 2
    max_df_ratio: float = 0.95
    low: int = 1
    high: int = 2
    use_stopwords: bool = True
    sublinear_tf: bool = True
    alpha: float = 1.0


def document_terms(docs: DataFrame, params: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, term, tf). Terms are counted before anything else is done with them: the one large shuffle."""
    words = word_tokens(F.col(text_col))
    if params.use_stopwords:
        words = F.filter(words, lambda w: ~w.isin(*lx.STOP_WORDS))
    rows = docs.select(F.col(id_col).alias("doc_id"), words.alias("w"))
    return rows.select("doc_id", F.explode(ngrams(F.col("w"), params.low, params.high)).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def vocabulary(terms: DataFrame, members: DataFrame, params: Params = Params()) -> DataFrame:
    """(fold, term, df, idf) of the terms of the members (fold, doc_id): those in min_df documents and at most a share,
    the most frequent max_features of them, then by term."""
    sizes = members.groupBy("fold").agg(F.count("*").alias("docs"))
    df = terms.join(members, "doc_id").groupBy("fold", "term").agg(F.count("*").alias("df"))
    most = F.greatest(F.lit(1), F.floor(F.lit(params.max_df_ratio) * F.col("docs")))
    kept = df.join(F.broadcast(sizes), "fold").where((F.col("df") >= params.min_df) & (F.col("df") <= most))
    # The first of each of many parts hold the first of all, so no task ranks a whole vocabulary.
    order = (F.desc("df"), "term")
    for keys in (("fold", F.pmod(F.xxhash64("term"), F.lit(RANK_PARTS))), ("fold",)):
        kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= params.max_features)
    return kept.select("fold", "term", "df", (F.log((1 + F.col("docs")) / (1 + F.col("df"))) + 1).alias("idf"))


def vectors(terms: DataFrame, vocab: DataFrame, members: DataFrame, params: Params = Params()) -> DataFrame:
    """(fold, doc_id, term, weight) with unit length. A vocabulary has at most max_features rows a fold, so it is sent
    to the documents."""
    tf = F.log("tf") + 1 if params.sublinear_tf else F.col("tf").cast("double")
    rows = terms.join(members, "doc_id").join(F.broadcast(vocab.select("fold", "term", "idf")), ["fold", "term"]).select("fold", "doc_id", "term", (tf * F.col("idf")).alias("raw"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("fold", "doc_id")))
    return rows.select("fold", "doc_id", "term", (F.col("raw") / norm).alias("weight"))


def priors(labels: DataFrame) -> DataFrame:
    """(fold, label, log_prior) of the members (fold, doc_id, label)."""
    n = labels.groupBy("fold", "label").agg(F.count("*").alias("n"))
    return n.select("fold", "label", F.log(F.col("n") / F.sum("n").over(Window.partitionBy("fold"))).alias("log_prior"))


def likelihood(vecs: DataFrame, labels: DataFrame, params: Params = Params()) -> DataFrame:
    """(fold, label, term, log_prob) over every class and every term of the training vectors of its fold. The sums are
    computed once; the windows hold at most max_features rows."""
    sums = vecs.join(labels, ["fold", "doc_id"]).groupBy("fold", "term", "label").agg(F.sum("weight").alias("w"))
    by_term = sums.groupBy("fold", "term").agg(F.map_from_entries(F.collect_list(F.struct("label", "w"))).alias("m"))  # one entry a class
    names = labels.groupBy("fold").agg(F.collect_set("label").alias("names"))
    grid = by_term.join(F.broadcast(names), "fold").select("fold", "term", "m", F.explode("names").alias("label"))
    rows = grid.select("fold", "label", "term", F.coalesce(F.col("m")[F.col("label")], F.lit(0.0)).alias("w"))
    of_class = Window.partitionBy("fold", "label")
    return rows.select("fold", "label", "term", F.log((F.col("w") + params.alpha) / (F.sum("w").over(of_class) + params.alpha * F.count("*").over(of_class))).alias("log_prob"))


def log_scores(vecs: DataFrame, prior: DataFrame, like: DataFrame, members: DataFrame) -> DataFrame:
    """(fold, doc_id, label, score) of every member and class; without known terms the prior alone."""
    own = vecs.join(F.broadcast(like), ["fold", "term"]).groupBy("fold", "doc_id", "label").agg(F.sum(F.col("weight") * F.col("log_prob")).alias("s"))
    every = members.select("fold", "doc_id").join(F.broadcast(prior), "fold")
    return every.join(own, ["fold", "doc_id", "label"], "left").select("fold", "doc_id", "label", (F.col("log_prior") + F.coalesce("s", F.lit(0.0))).alias("score"))


def predictions(scored: DataFrame) -> DataFrame:
    """(fold, doc_id, predicted): the class of highest score at nine decimals, the first by name of equal ones."""
    w = Window.partitionBy("fold", "doc_id").orderBy(F.desc(F.round("score", 9)), "label")
    return scored.withColumn("rank", F.row_number().over(w)).where("rank = 1").select("fold", "doc_id", F.col("label").alias("predicted"))


def probabilities(scored: DataFrame) -> DataFrame:
    """(fold, doc_id, label, probability), by softmax over the scores of a document."""
    w = Window.partitionBy("fold", "doc_id")
    rows = scored.withColumn("e", F.exp(F.col("score") - F.max("score").over(w)))
    return rows.select("fold", "doc_id", "label", (F.col("e") / F.sum("e").over(w)).alias("probability"))


def informative(like: DataFrame, k: int = 20) -> DataFrame:
    """(fold, label, rank, term, ratio): the terms whose log probability exceeds the mean of the other classes most; for
    a single class, the most probable."""
    w = Window.partitionBy("fold", "term")
    n, total = F.count("*").over(w), F.sum("log_prob").over(w)
    ratio = F.when(n > 1, F.col("log_prob") - (total - F.col("log_prob")) / (n - 1)).otherwise(F.col("log_prob"))
    rows = like.select("fold", "label", "term", F.round(ratio, 4).alias("ratio"))
    order = Window.partitionBy("fold", "label").orderBy(F.desc("ratio"), "term")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("fold", "label", "rank", "term", "ratio")


def confusion(pairs: DataFrame) -> DataFrame:
    """(fold, label, predicted, n) of every pair of classes, zeros included. Pairs: (fold, label, predicted); they are
    counted once, and the table of a fold is built from the counts."""
    n = pairs.groupBy("fold", "label", "predicted").agg(F.count("*").alias("n"))
    whole = n.groupBy("fold").agg(F.collect_list(F.struct("label", "predicted", "n")).alias("t"))  # classes times classes
    names = F.array_sort(F.array_distinct(F.concat(F.transform("t", lambda x: x["label"]), F.transform("t", lambda x: x["predicted"]))))
    grid = whole.select("fold", "t", names.alias("names")).select("fold", "t", "names", F.explode("names").alias("label")).select("fold", "t", "label", F.explode("names").alias("predicted"))
    found = F.filter("t", lambda x: (x["label"] == F.col("label")) & (x["predicted"] == F.col("predicted")))
    return grid.select("fold", "label", "predicted", F.coalesce(F.get(found, F.lit(0))["n"], F.lit(0)).cast("long").alias("n"))


def class_metrics(table: DataFrame) -> DataFrame:
    """(fold, label, precision, recall, f1, support, tp) from a confusion table; 0 where a denominator is."""
    hit = F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0)
    zero = F.lit(0).cast("long")
    both = F.explode(F.array(F.struct(F.col("label").alias("c"), F.col("n").alias("s"), hit.cast("long").alias("h"), zero.alias("p")), F.struct(F.col("predicted").alias("c"), zero.alias("s"), zero.alias("h"), F.col("n").alias("p"))))
    rows = table.select("fold", both.alias("x")).groupBy("fold", F.col("x.c").alias("label")).agg(F.sum("x.s").alias("support"), F.sum("x.h").alias("tp"), F.sum("x.p").alias("named"))
    p = F.when(F.col("named") > 0, F.col("tp") / F.col("named")).otherwise(0.0)
    r = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    rows = rows.select("fold", "label", p.alias("precision"), r.alias("recall"), "support", "tp")
    return rows.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def metrics(pairs: DataFrame) -> DataFrame:
    """(fold, accuracy, macro_precision, macro_recall, macro_f1, weighted_f1, n)."""
    own = class_metrics(confusion(pairs))
    n = F.sum("support")
    return own.groupBy("fold").agg((F.sum("tp") / n).alias("accuracy"), F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"), (F.sum(F.col("f1") * F.col("support")) / n).alias("weighted_f1"), n.alias("n"))


def metrics_text(pairs: DataFrame) -> DataFrame:
    """(fold, text): accuracy and F1, then a line for each class by name. Pairs: (fold, label, predicted)."""
    own = class_metrics(confusion(pairs))
    line = F.format_string("%-20s %10.4f %10.4f %10.4f %10d", "label", "precision", "recall", "f1", "support")
    lines = own.groupBy("fold").agg(F.transform(F.array_sort(F.collect_list(F.struct("label", line.alias("line")))), lambda x: x["line"]).alias("lines"))  # one a class
    head = F.array(F.format_string("Accuracy: %.2f%%", F.col("accuracy") * 100), F.format_string("Macro F1: %.4f", "macro_f1"), F.format_string("Weighted F1: %.4f", "weighted_f1"), F.lit(""), F.lit(f"{'Class':<20} {'Precision':>10} {'Recall':>10} {'F1':>10} {'Support':>10}"), F.lit("-" * 62))
    return metrics(pairs).join(lines, "fold").select("fold", F.array_join(F.concat(head, "lines"), "\n").alias("text"))


def stratified_folds(labels: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """(doc_id, label, fold): each class dealt to k folds in turn, in the order of a hash of seed and id."""
    if k < 2:
        raise ValueError("k must be at least 2")
    # Rows are ranked within 4,096 parts in the order of the hash, and counts of the parts before are added: a class is
    # never one task.
    rows = labels.select("doc_id", "label", F.md5(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string"))).alias("hash")).withColumn("part", F.substring("hash", 1, 3))
    sizes = rows.groupBy("label", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("label").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("label", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    rank = F.row_number().over(Window.partitionBy("label", "part").orderBy("hash", "doc_id")) - 1
    ranked = rows.withColumn("rank", rank).join(starts, ["label", "part"])
    return ranked.select("doc_id", "label", F.pmod(F.col("start") + F.col("rank"), F.lit(k)).cast("int").alias("fold"))


def cross_validated(docs: DataFrame, labels: DataFrame, k: int = 3, params: Params = Params(), seed: int = 42) -> DataFrame:
    """`metrics` of each of k folds, all in one plan; a document trains every fold but its own. docs: (doc_id, text),
    labels: (doc_id, label)."""
    dealt = stratified_folds(labels, k, seed)
    folds = F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    train = dealt.select("doc_id", "label", F.col("fold").alias("own"), folds.alias("fold")).where("own <> fold").select("fold", "doc_id", "label")
    terms = document_terms(docs.join(dealt.select("doc_id"), "doc_id"), params)
    vocab = vocabulary(terms, train.select("fold", "doc_id"), params)
    like = likelihood(vectors(terms, vocab, train.select("fold", "doc_id"), params), train, params)
    test = dealt.select("fold", "doc_id")
    scored = log_scores(vectors(terms, vocab, test, params), priors(train), like, test)
    return metrics(predictions(scored).join(dealt, ["fold", "doc_id"]).select("fold", "label", "predicted"))


@dataclass
class DocumentClassifier:
    """Trains, applies, evaluates, saves and loads; a model is three small tables and its parameters."""

    params: Params = field(default_factory=Params)
    vocab: DataFrame | None = None
    prior: DataFrame | None = None
    like: DataFrame | None = None

    @property
    def is_trained(self) -> bool:
        return self.like is not None

    def _need(self) -> None:
        if not self.is_trained:
            raise RuntimeError("the classifier is not trained")

    def train(self, docs: DataFrame, labels: DataFrame) -> DataFrame:
        """Fits the model; returns its metrics on the training documents."""
        members = labels.select(F.lit(0).alias("fold"), "doc_id", "label")
        terms = document_terms(docs.join(labels.select("doc_id"), "doc_id"), self.params)
        self.vocab = vocabulary(terms, members.select("fold", "doc_id"), self.params)
        vecs = vectors(terms, self.vocab, members.select("fold", "doc_id"), self.params)
        self.prior, self.like = priors(members), likelihood(vecs, members, self.params)
        named = predictions(log_scores(vecs, self.prior, self.like, members))
        return metrics(named.join(members, ["fold", "doc_id"]).select("fold", "label", "predicted"))

    def scores(self, docs: DataFrame) -> DataFrame:
        self._need()
        members = docs.select(F.lit(0).alias("fold"), "doc_id")
        return log_scores(vectors(document_terms(docs, self.params), self.vocab, members, self.params), self.prior, self.like, members)

    def classify(self, docs: DataFrame) -> DataFrame:
        """(doc_id, predicted, confidence, probabilities)."""
        scored = self.scores(docs)
        proba = probabilities(scored).groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "probability")))).alias("probabilities"))  # one entry a class
        return predictions(scored).join(proba, "doc_id").select("doc_id", "predicted", F.element_at("probabilities", F.col("predicted")).alias("confidence"), "probabilities")

    def evaluate(self, docs: DataFrame, labels: DataFrame, k: int = 3) -> DataFrame:
        return cross_validated(docs, labels, k, self.params)

    def most_informative(self, label: str, k: int = 20) -> DataFrame:
        self._need()
        if self.prior.where(F.col("label") == label).isEmpty():
            raise ValueError(f"unknown class: {label}")
        return informative(self.like, k).where(F.col("label") == label).drop("fold")

    def save(self, path: str) -> None:
        self._need()
        for name in ("vocab", "prior", "like"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")
        spark = self.like.sparkSession
        spark.createDataFrame([(json.dumps({"version": "1.0", **asdict(self.params)}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/params")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> DocumentClassifier:
        stored = json.loads(spark.read.text(f"{path}/params").first()[0])
        stored.pop("version")
        return cls(Params(**stored), *[spark.read.parquet(f"{path}/{name}") for name in ("vocab", "prior", "like")])
