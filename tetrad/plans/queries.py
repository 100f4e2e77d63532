"""The registered queries: one callable ``(spark, base_dir) -> DataFrame`` per
operator of the inventory. Each reads the driver's tables (through the
fixtures) so its work grows with them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tetrad import dims
from tetrad.functions import arrays as A
from tetrad.functions import text as T
from tetrad.operators import batching, epochs, metrics, model, rank, sampling, scoring, sessions, softmaxfit
from tetrad.operators import wordpiece as wp
from tetrad.plans import fixtures as fx
from tetrad.sources import posts as posts_src
from tetrad.session import materialize, scratch_path
from tetrad.sources import variants as variants_src
from tetrad.sources import vocab as vocab_src
from tetrad.sources.tables import read_table, spread
from tetrad.streaming import committed, livescore, transcript

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def reg(fn):
        QUERIES[name] = fn
        return fn
    return reg


# --- dataset building (E1) -------------------------------------------------

@query("class_counts")
def q_class_counts(spark, base):
    return sampling.class_counts(fx.posts(spark, base))


@query("resample_plan")
def q_resample_plan(spark, base):
    p = fx.posts(spark, base)
    out = None
    for v in ("bal", "prop"):
        plan = sampling.resample_plan(p, dims.priors(spark, v)).withColumn("variant", F.lit(v))
        out = plan if out is None else out.unionByName(plan)
    return out.select("variant", "type", "posts", "real_frac", "maximal_count", "sample_cnt")


def _resample(spark, base, variant):
    p = fx.posts(spark, base)
    return (sampling.resample(p, dims.priors(spark, variant))
            .select("post_id", "posts", "type", "order_key"))


@query("resample_balanced")
def q_resample_balanced(spark, base):
    return _resample(spark, base, "bal")


@query("resample_proportional")
def q_resample_proportional(spark, base):
    return _resample(spark, base, "prop")


@query("train_eval_split")
def q_train_eval_split(spark, base):
    p = fx.post_types(spark, base)
    return sampling.train_eval_split(p).select("post_id", "type", "split_key", "split")


@query("resample_faulty")
def q_resample_faulty(spark, base):
    """Resampling from posts with load faults: only valid ones are counted and
    drawn (P4, A1)."""
    valid, _ = posts_src.validate(_faulty_posts(spark, base), spark)
    return (sampling.resample(valid, dims.priors(spark, "prop"))
            .select("post_id", "posts", "type", "order_key"))


@query("resample_both")
def q_resample_both(spark, base):
    """Both flags: proportional, then balanced, named after the first."""
    return (sampling.resample_both(fx.posts(spark, base), dims.priors(spark))
            .select("variant", "post_id", "posts", "type"))


@query("split_sizes")
def q_split_sizes(spark, base):
    v = sampling.dataset_variants(spark, fx.post_types(spark, base))
    return v.groupBy("variant", "split").agg(F.count(F.lit(1)).alias("n"))


# --- loading and text (S1, P1-P11, F1-F3) -----------------------------------

def _faulty_posts(spark, base):
    """``posts`` with load faults spread over the whole table: every 50th
    post (offset 21) lost its text, offset 7 has an unknown type, offset 13
    a lower-case type (accepted after normalization)."""
    p = fx.posts(spark, base)
    r = F.col("post_id") % 50
    return p.select(
        "post_id",
        F.when(r == 21, F.lit(None).cast("string")).otherwise(F.col("posts")).alias("posts"),
        F.when(r == 7, F.lit("XXXX")).when(r == 13, F.lower("type")).otherwise(F.col("type"))
        .alias("type"))


@query("load_posts")
def q_load_posts(spark, base):
    valid, _ = posts_src.validate(_faulty_posts(spark, base), spark)
    return valid.select("post_id", "posts", "type", "target")


@query("rejects")
def q_rejects(spark, base):
    _, rej = posts_src.validate(_faulty_posts(spark, base), spark)
    return rej


def _raw_split(spark, base, with_text=True):
    p = fx.posts(spark, base) if with_text else fx.post_types(spark, base)
    return sampling.train_eval_split(p)


@query("label_encode")
def q_label_encode(spark, base):
    s = posts_src.with_label(_raw_split(spark, base, with_text=False), spark)
    mbti = T.normalize_label("type")
    return s.select("post_id", "split", mbti.alias("mbti"), "target",
                    F.when(F.col("split") == "eval", mbti).alias("gold"))


def _truncate(n):
    def q(spark, base):
        return fx.posts(spark, base).select("post_id", T.first_words("posts", n).alias("words"))
    return q


for _n in (502, 256, 300):
    QUERIES[f"truncate_words_{_n}"] = _truncate(_n)


@query("prompt_build")
def q_prompt_build(spark, base):
    return fx.posts(spark, base).select(
        "post_id", T.prompt("posts", dims.MAX_LENGTH // 2, indent=12).alias("prompt"))


@query("generation_examples")
def q_generation_examples(spark, base):
    s = _raw_split(spark, base)
    pr = T.prompt("posts", 300, indent=8)
    return s.select("post_id", "split",
                    T.training_text(pr, T.normalize_label("type"), "split").alias("example"))


@query("preview")
def q_preview(spark, base):
    """First training example in loader order (P11, T5): top-1 by the
    stored order key, a bounded TakeOrderedAndProject."""
    s = _raw_split(spark, base).where(F.col("split") == "train")
    return (s.orderBy("split_key", "post_id").limit(1)
            .select("post_id", T.plain_input("posts").alias("model_input"),
                    T.normalize_label("type").alias("mbti")))


@query("basic_tokens")
def q_basic_tokens(spark, base):
    """Token frequencies of all documents."""
    return wp.word_counts(_docs(spark, base)).select(F.col("w").alias("token"), "n")


# --- scores, ranking, metrics (F11, W2, T1, T3, T4, A5-A13, M4, M5) --------

def _probs(spark, base):
    return scoring.with_probs(fx.scores(spark, base))


def _preds(spark, base):
    return scoring.predictions(_probs(spark, base))


@query("softmax")
def q_softmax(spark, base):
    lp = scoring.long_probs(_probs(spark, base))
    return lp.select("post_id", "idx", F.round("p", 9).alias("p"))


@query("class_ranking")
def q_class_ranking(spark, base):
    return scoring.ranked_long(_probs(spark, base)).select("post_id", "rk", "name")


@query("predictions")
def q_predictions(spark, base):
    return _preds(spark, base).select("post_id", "gold", "answer_idx", "answer",
                                      F.round("confidence", 9).alias("confidence"), "gold_rank")


@query("top5")
def q_top5(spark, base):
    t = scoring.ranked_long(_probs(spark, base), k=5)
    return t.select("post_id", "rk", "name", F.round("p", 9).alias("p"))


@query("top10_string")
def q_top10_string(spark, base):
    return _preds(spark, base).select("post_id", scoring.top_k_string("ranking", 10).alias("top10"))


@query("hit_at_k")
def q_hit_at_k(spark, base):
    m = metrics.classification_metrics(_preds(spark, base))
    return m.select("n", "hit_3", "hit_5", "hit_10")


@query("metrics_16way")
def q_metrics_16way(spark, base):
    return metrics.classification_metrics(_preds(spark, base))


@query("match_histogram")
def q_match_histogram(spark, base):
    return metrics.match_histogram(_preds(spark, base))


@query("ce_double_softmax")
def q_ce_double_softmax(spark, base):
    p = _probs(spark, base).withColumn("_t", (F.array_position(dims.class_name_array(),
                                                               F.col("gold")) - 1).cast("int"))
    return p.agg(F.count(F.lit(1)).alias("n"),
                 F.round(F.avg(A.double_softmax_ce("p", F.col("_t"))), 9).alias("ce"))


@query("ce_plain")
def q_ce_plain(spark, base):
    p = _probs(spark, base).withColumn("_t", (F.array_position(dims.class_name_array(),
                                                               F.col("gold")) - 1).cast("int"))
    return p.agg(F.count(F.lit(1)).alias("n"),
                 F.round(F.avg(A.plain_ce("p", F.col("_t"))), 9).alias("ce"))


@query("axis_bits")
def q_axis_bits(spark, base):
    p = posts_src.with_label(fx.post_types(spark, base), spark)
    bits = A.idx_to_bits("target")
    back = A.bits_to_idx(*[F.substring(bits, i + 1, 1).cast("int") for i in range(4)])
    return p.select("post_id", "target", bits.alias("bits"), back.alias("idx_back"))


@query("axis_compose")
def q_axis_compose(spark, base):
    c = scoring.compose_axes(fx.axis_scores(spark, base))
    return c.select("post_id", "gold", "bits", "answer_idx", "answer")


@query("metrics_axes")
def q_metrics_axes(spark, base):
    c = scoring.compose_axes(fx.axis_scores(spark, base))
    return metrics.classification_metrics(c, gold_rank=None)


@query("ce_axes")
def q_ce_axes(spark, base):
    """Axis loss (A13): 4 two-class rows per post, softmax applied twice."""
    a = fx.axis_scores(spark, base)
    gidx = (F.array_position(dims.class_name_array(), F.col("gold")) - 1).cast("int")
    rows = a.select(F.posexplode("p1").alias("i", "p1"), gidx.alias("_g"))
    tgt = F.expr("shiftright(_g, 3 - i) & 1")
    pt = F.when(tgt == 1, F.col("p1")).otherwise(1.0 - F.col("p1"))
    ce = F.log(F.exp(1.0 - F.col("p1")) + F.exp(F.col("p1"))) - pt
    return rows.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(ce), 9).alias("ce"))


def head_matrix():
    """A fixed 16 x 64 linear head: w[i][j] = (((i*13 + j*7) % 11) - 5) / 10."""
    return [[(((i * 13 + j * 7) % 11) - 5) / 10 for j in range(64)] for i in range(16)]


@query("linear_head")
def q_linear_head(spark, base):
    e = spread(read_table(spark, base, "embeddings").select("vec_id", "embedding"))
    s = scoring.with_probs(scoring.linear_head(e, head_matrix()), "logits", "p")
    return s.select("vec_id", F.posexplode(F.arrays_zip("logits", "p")).alias("idx", "lp")) \
        .select("vec_id", "idx", F.round("lp.logits", 6).alias("logit"),
                F.round("lp.p", 9).alias("p"))


# --- generation output (F14, F15, A11) -------------------------------------

@query("parse_generation")
def q_parse_generation(spark, base):
    g = fx.generations(spark, base)
    return g.select("post_id", "gold", T.parse_answer("g").alias("answer"))


@query("metrics_generation")
def q_metrics_generation(spark, base):
    g = fx.generations(spark, base).withColumn("answer", T.parse_answer("g"))
    return metrics.generation_metrics(g)


@query("generation_log")
def q_generation_log(spark, base):
    g = fx.generations(spark, base)
    return g.select("post_id", T.with_gold("g", "gold").alias("log"))


# --- vocabulary and tokens (S4, S5, F4, F5, T6) -----------------------------

#: size of the fixture vocabulary: frequent words, frequent endings
VOCAB_WORDS, VOCAB_ENDINGS = 400, 60


def _docs(spark, base, *columns):
    return spread(read_table(spark, base, "documents").select("text", *columns))


_VOCABS: dict = {}


def release():
    """Give up what queries keep in memory: vocabularies and small tables."""
    for counts, vocab, _ in _VOCABS.values():
        counts.unpersist()
        vocab.unpersist()
    _VOCABS.clear()
    rank.release()


def prompt_words(spark) -> list[str]:
    """Basic tokens of the instruction: always in the vocabulary."""
    row = spark.range(1).select(T.basic_tokens(F.lit(dims.instruction(8))).alias("w")).first()
    return sorted(set(row.w))


def _vocab(spark, base):
    """(word counts of all documents, vocabulary, its ids). The vocabulary
    plays the reference's vocab.txt - a dimension loaded once - so it is built
    once per session and input folder and cached (a lost block is rebuilt
    from its lineage)."""
    key = (spark.sparkContext.applicationId, base)
    if key not in _VOCABS:
        counts = wp.word_counts(_docs(spark, base)).cache()
        vocab = vocab_src.build_vocab(None, VOCAB_WORDS, VOCAB_ENDINGS, counts=counts, always=prompt_words(spark)).cache()
        _VOCABS[key] = (counts, vocab, wp.vocab_ids(vocab))
    return _VOCABS[key]


@query("vocab_lookup")
def q_vocab_lookup(spark, base):
    """Build, export as vocab.txt (S5), load back by line number."""
    path = scratch_path(spark, f"vocab-{uuid.uuid4().hex}")
    vocab_src.export_vocab_text(_vocab(spark, base)[1], path)
    return vocab_src.load_vocab_text(spark, path)


@query("wordpiece_ids")
def q_wordpiece_ids(spark, base):
    counts, v, ids = _vocab(spark, base)
    t = wp.tokenize_words(counts.select("w"), v, ids=ids)
    return t.select("w", A.join_ints("ids").alias("ids"))


@query("encode_capped")
def q_encode_capped(spark, base):
    _, v, ids = _vocab(spark, base)
    e = wp.encode_posts(fx.posts(spark, base), v, ids=ids)
    return e.select("post_id", "n_ids", A.join_ints("ids").alias("ids"))


@query("unk_rate")
def q_unk_rate(spark, base):
    _, v, ids = _vocab(spark, base)
    return wp.unk_rate(_docs(spark, base, "lang"), v, ids=ids)


@query("device_tokens")
def q_device_tokens(spark, base):
    """The phone's tokenizer (F5) over every source, with the words it drops.
    Its vocabulary here lacks the single characters, so some are."""
    _, v, ids = _vocab(spark, base)
    v = v.where(F.length(F.regexp_replace("piece", "^##", "")) > 1)
    return wp.device_rate(_docs(spark, base, "source"), v, ids=ids)


# --- dataset variants on disk (S2, S3, J3, U2, A17) --------------------------

VARIANTS = ("raw", "bal", "prop")
REDRAW_SEED = 7

def _variant_store(spark, base, posts):
    """The posts stored once and the three variants beside them, drawn from ids
    and labels (S2, U3)."""
    store = variants_src.create_store(posts, scratch_path(spark, f"variants-{uuid.uuid4().hex}"))
    drawn = materialize(sampling.dataset_variants(spark, fx.post_types(spark, base)).select("variant", "split", "post_id"),
                        "members")
    for v in VARIANTS:
        store.put(v, drawn.where(F.col("variant") == v))
    return store


@query("variant_slice")
def q_variant_slice(spark, base):
    """All variants written as membership beside the posts (S2), one dataset
    read back by a join of equal buckets (S3)."""
    return _variant_store(spark, base, fx.posts(spark, base)).read("bal", "train").select("post_id", "posts", "type")


@query("variant_redrawn")
def q_variant_redrawn(spark, base):
    """The balanced variant replaced by a draw of another seed, through a store
    opened anew; the posts and the other variants stay (S2, S3, U3). Rows and
    words of every dataset."""
    store = variants_src.open_store(spark, _variant_store(spark, base, fx.posts(spark, base)).path)
    again = sampling.resample(fx.post_types(spark, base), dims.priors(spark, "bal"), seed=REDRAW_SEED).drop(rank.KEY)
    store.put("bal", sampling.train_eval_split(again, seed=REDRAW_SEED))
    out = None
    for v in VARIANTS:
        j = store.posts().join(store.ids(v).hint("shuffle_hash"), "post_id")
        one = j.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("post_id").alias("ids"),
                                     F.sum(F.char_length("posts")).alias("chars"))
        one = one.select(F.lit(v).alias("variant"), "split", "n", "ids", "chars")
        out = one if out is None else out.unionByName(one)
    return out


@query("split_anti")
def q_split_anti(spark, base):
    """Eval = all rows minus the training rows (J3/U2 as an anti join)."""
    p = fx.post_types(spark, base)
    train = _raw_split(spark, base, with_text=False).where(F.col("split") == "train").select("post_id")
    return p.join(train, "post_id", "left_anti").select("post_id", "type")


@query("metrics_by_variant")
def q_metrics_by_variant(spark, base):
    """16-way and axis metrics of every dataset variant's eval split in one
    aggregation per task (A17, M7)."""
    v = sampling.dataset_variants(spark, fx.post_types(spark, base)).where(F.col("split") == "eval")
    v = v.select("variant", "post_id", F.lower("type").alias("gold"))
    probs = scoring.with_probs(v.withColumn("z", fx.score_logits(F.col("post_id"))))
    names = F.transform(A.ranking_idx("p"), A.idx_to_name)
    ax = scoring.compose_axes(probs.withColumn("ranking", names).withColumn("p1", fx.axis_probs(F.col("post_id"))))
    both = F.array(
        F.struct(F.lit("16way").alias("task"), F.element_at("ranking", 1).alias("answer"),
                 F.array_position("ranking", F.col("gold")).alias("gold_rank")),
        F.struct(F.lit("axes").alias("task"), F.col("answer"), F.lit(None).cast("long").alias("gold_rank")))
    rows = ax.select("variant", "gold", F.explode(both).alias("t")).select("variant", "gold", "t.*")
    m = metrics.classification_metrics(rows, groups=["variant", "task"])
    for k in metrics.HIT_KS:
        m = m.withColumn(f"hit_{k}", F.when(F.col("task") == "16way", F.col(f"hit_{k}")))
    return m


# --- batches, padding, labels, epoch loss (W3, W4, F6-F8, A14, A15) ----------

BATCH = 64


def _train_batches(spark, base, batch_size=BATCH):
    """Batches over the training rows of the raw split (ids only): training
    rows are the first floor(n * 0.9) in split-key order, so the batch ranks
    are the split ranks themselves."""
    keyed = fx.post_types(spark, base).select("post_id", "type", sampling.split_key().alias("split_key"))
    return batching.batches(keyed, "split_key", "post_id", batch_size, ratio=sampling.TRAIN_RATIO)


@query("batches")
def q_batches(spark, base):
    return _train_batches(spark, base).select("post_id", "batch_id", "pos")


def _token_labels(spark, base):
    """Token rows of every post: prompt + target as WordPiece ids, cut at 512."""
    _, v, ids = _vocab(spark, base)
    rows = fx.token_rows(spark, base, v, ids)
    return batching.token_labels(rows, "prompt_ids", "target_ids", max_length=dims.MAX_LENGTH)


@query("padded_batches")
def q_padded_batches(spark, base):
    b = batching.with_batch(_token_labels(spark, base).select("post_id", "input_ids"), _train_batches(spark, base))
    p = batching.pad_batches(b, "input_ids")
    return p.select("post_id", "batch_id", A.join_ints("padded").alias("ids"),
                    A.join_ints("mask").alias("mask"))


@query("collated_batches")
def q_collated_batches(spark, base):
    """What the collator hands to training: ids, labels and mask per batch."""
    b = batching.with_batch(_token_labels(spark, base).select("post_id", "input_ids", "labels"), _train_batches(spark, base))
    p = batching.pad_batches(b, "input_ids", labels="labels")
    return p.select("post_id", "batch_id", "pos", A.join_ints("padded").alias("ids"),
                    A.join_ints("padded_labels").alias("labels"), A.join_ints("mask").alias("mask"))


@query("token_labels")
def q_token_labels(spark, base):
    out = _token_labels(spark, base)
    return out.select("post_id", A.join_ints("labels").alias("labels"), "n_nonpad",
                      A.join_ints("shifted").alias("shifted"), "n_supervised")


EPOCHS = 3


def _epoch_table(spark, base):
    """Per-epoch batch losses of a synthetic training run: epoch e adds e to
    the gold logit of the scores fixture; loss is the reference's
    double-softmax cross-entropy; batches of 64, last partial one dropped. The
    run's clock is synthetic too: a quarter second a batch, and a save that
    takes an eighth of a second more with every epoch."""
    b = _train_batches(spark, base)
    gidx = (F.array_position(dims.class_name_array(), F.lower("type")) - 1).cast("int")
    rows = b.select("batch_id", gidx.alias("_g"), fx.score_logits(F.col("post_id")).alias("z"),
                    F.explode(F.sequence(F.lit(1), F.lit(EPOCHS))).alias("epoch"))
    rows = rows.withColumn("ze", F.transform("z", lambda x, i: x + F.when(
        i == F.col("_g"), F.col("epoch").cast("double")).otherwise(F.lit(0.0))))
    rows = rows.withColumn("p", A.softmax("ze"))
    per_batch = rows.groupBy("epoch", "batch_id").agg(
        F.avg(A.double_softmax_ce("p", F.col("_g"))).alias("loss"))
    times = per_batch.groupBy("epoch").agg((F.count(F.lit(1)) * F.lit(0.25)).alias("secs")) \
        .withColumn("ckpt_secs", F.col("epoch") * F.lit(0.125))
    return metrics.epoch_loss(per_batch).join(times, "epoch")


@query("epoch_perplexity")
def q_epoch_perplexity(spark, base):
    return _epoch_table(spark, base).select("epoch", "loss", "perplexity")


@query("run_summary")
def q_run_summary(spark, base):
    return metrics.run_summary(_epoch_table(spark, base))


# --- transcript and sessions (W5, W6) ---------------------------------------

@query("running_transcript")
def q_running_transcript(spark, base):
    return sessions.running_transcript(fx.utterances(spark, base))


@query("marker_sessions")
def q_marker_sessions(spark, base):
    m = sessions.marker_sessions(fx.marked_events(spark, base))
    return m.select("user_id", "event_id", "session_no")


# --- models (M1-M3, M6, M7, S6) ------------------------------------------------

def _labelled_split(spark, base):
    s = sampling.train_eval_split(posts_src.with_label(fx.posts(spark, base), spark))
    return model.with_model_input(s).withColumn("gold", T.normalize_label("type"))


@query("train_score_16way")
def q_train_score_16way(spark, base):
    """Fit on the training split, score the eval split (M1, M3), rank."""
    s = _labelled_split(spark, base)
    m = model.fit_16way(s.where(F.col("split") == "train"))
    scored = model.score_16way(m, s.where(F.col("split") == "eval"))
    return scoring.predictions(scored).select("post_id", "gold", "answer", "confidence")


@query("train_score_axes")
def q_train_score_axes(spark, base):
    """Four per-letter models over shared features (M2), composed (M4)."""
    s = _labelled_split(spark, base)
    feats, models = model.fit_axes(s.where(F.col("split") == "train"))
    scored = model.score_axes(feats, models, s.where(F.col("split") == "eval"))
    return scoring.compose_axes(scored).select("post_id", "gold", "bits", "answer")


TRAIN_EPOCHS, TRAIN_RATE, TRAIN_STEPS = 2, 0.05, 2


def _epoch_training(spark, base):
    """Labelled posts with the features of their prompted input, the folder of
    a training run over the batches of the raw split, and the run's log."""
    posts = posts_src.with_label(fx.posts(spark, base), spark)
    rows = model.with_model_input(posts, prompted=True).withColumn("gold", T.normalize_label("type"))
    rows = materialize(rows.select("post_id", "type", "gold", "target", epochs.token_shares().alias("x")), "post-shares")
    batched = batching.with_batch(rows.select("post_id", "target", "x"), _train_batches(spark, base))
    batched = epochs.in_batch_order(batched)
    n = batched.agg(F.max("batch_id")).first()[0] + 1
    path = model.model_path(scratch_path(spark, f"run-{uuid.uuid4().hex}"), "raw", "epochs")
    log = epochs.train(batched, path, TRAIN_EPOCHS, TRAIN_RATE, accumulate=-(-n // TRAIN_STEPS))
    return rows, path, log


@query("train_log")
def q_train_log(spark, base):
    """Loss and perplexity per epoch of a real run (M6, A14): two epochs of two
    accumulated steps each, every epoch saved (S6). The clock differs from run
    to run, so only its being there is reported."""
    log = _epoch_training(spark, base)[2]
    return log.select("epoch", F.round("loss", 8).alias("loss"), F.round("perplexity", 8).alias("perplexity"), "steps",
                      ((F.col("secs") > 0) & (F.col("ckpt_secs") > 0)).alias("timed"))


@query("epoch_score_16way")
def q_epoch_score_16way(spark, base):
    """Eval posts scored by the model that the last epoch saved."""
    rows, path, _ = _epoch_training(spark, base)
    split = sampling.train_eval_split(fx.post_types(spark, base)).where("split = 'eval'").select("post_id")
    scored = epochs.score(rows.join(split, "post_id"), epochs.load(spark, path, TRAIN_EPOCHS))
    return scoring.predictions(scored).select("post_id", "gold", "answer", "gold_rank", F.round("confidence", 6).alias("confidence"))


#: steps, rate and penalty of the full-batch fits
SOFTMAX = {"steps": 3, "rate": 4.0, "penalty": 0.001}


def _share_rows(spark, base):
    """Training and eval posts with the shares of their whole model input."""
    s = _labelled_split(spark, base)
    letters = [F.shiftright("target", 3 - i).bitwiseAND(1).cast("int").alias(f"letter{i}") for i in range(4)]
    rows = materialize(s.select("post_id", "gold", "split", F.col("target").cast("int").alias("target"), *letters,
                                epochs.token_shares().alias("x")), "share-rows")
    return rows.where("split = 'train'"), rows.where("split = 'eval'")


@query("softmax_score_16way")
def q_softmax_score_16way(spark, base):
    """Logistic 16-way fit by full-batch steps on exact sums, eval rows scored
    and ranked (M1, M3, T1); every step is spelled out in the SQL."""
    train, ev = _share_rows(spark, base)
    scored = softmaxfit.score(ev, softmaxfit.fit(train, [("target", 16)], **SOFTMAX)).withColumnRenamed("p_target", "p")
    return scoring.predictions(scored).select("post_id", "gold", "answer", "gold_rank", F.round("confidence", 6).alias("confidence"))


@query("softmax_score_axes")
def q_softmax_score_axes(spark, base):
    """The four letters fitted as four heads in the same passes (M2), composed
    (M4)."""
    train, ev = _share_rows(spark, base)
    heads = [(f"letter{i}", 2) for i in range(4)]
    scored = softmaxfit.score(ev, softmaxfit.fit(train, heads, **SOFTMAX))
    p1 = F.array(*[F.element_at(f"p_{n}", 2) for n, _ in heads])
    return scoring.compose_axes(scored.select("post_id", "gold", p1.alias("p1"))) \
        .select("post_id", "gold", "bits", "answer", F.transform("p1", lambda v: F.round(v, 6)).alias("p1")) \
        .select("post_id", "gold", "bits", "answer", *[F.element_at("p1", i + 1).alias(f"p{i}") for i in range(4)])


@query("softmax_head_log")
def q_softmax_head_log(spark, base):
    """The linear head over given vectors (M5) fitted on all embeddings, with
    the 16-way and the letters' loss before every step (M6)."""
    e = spread(read_table(spark, base, "embeddings").select("vec_id", "embedding"))
    e = e.where("embedding is not null and forall(embedding, v -> v is not null and abs(v) < double('infinity'))")
    target = fx.class_of(F.col("vec_id"))
    letters = [F.shiftright(target, 3 - i).bitwiseAND(1).cast("int").alias(f"letter{i}") for i in range(4)]
    rows = e.select(target.alias("target"), *letters, F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    heads = [("target", 16)] + [(f"letter{i}", 2) for i in range(4)]
    log = softmaxfit.fit(materialize(rows, "head-rows"), heads, **SOFTMAX).log
    return spark.createDataFrame([(a, b, c, round(d, 8)) for a, b, c, d in log], "step int, head string, n long, loss double")


@query("count_score_16way")
def q_count_score_16way(spark, base):
    """Closed-form 16-way fit on the training split, eval rows scored and
    ranked (M1, M3, T1); the predictions go through a table (S7)."""
    s = _labelled_split(spark, base)
    m = model.fit_counts(s.where(F.col("split") == "train"))
    scored = model.score_counts(m, s.where(F.col("split") == "eval"))
    path = scratch_path(spark, f"predictions-{uuid.uuid4().hex}")
    best = scored.select("post_id", F.round(F.array_max("z"), 5).alias("z"))
    scoring.write_predictions(scoring.predictions(scored, probs="z"), path)   # far classes underflow in p
    return spark.read.parquet(path).join(best, "post_id").select("post_id", "gold", "answer", "gold_rank", "z")


@query("count_score_axes")
def q_count_score_axes(spark, base):
    """Closed-form fit per letter (M2), composed (M4)."""
    s = _labelled_split(spark, base)
    models = model.fit_axes_counts(s.where(F.col("split") == "train"))
    scored = model.score_axes_counts(models, s.where(F.col("split") == "eval"))
    return scoring.compose_axes(scored).select("post_id", "gold", "bits", "answer")


@query("count_metrics_by_variant")
def q_count_metrics_by_variant(spark, base):
    """The closed-form fit trained and evaluated on every dataset variant, both
    tasks, in one table (M7, A17). The posts are written once (S2); each variant
    reads its own dataset (S3), whose words are counted once for both tasks."""
    load = _variant_loader(spark, base)
    parts = []
    for v in VARIANTS:
        train, ev = load(v, "train"), load(v, "eval")
        counts, words = model.count_words(train), materialize(model.row_words(ev), "eval-words")
        p16 = scoring.predictions(model.score_counts(model.fit_counts(train, counts=counts), ev, words=words), probs="z") \
            .select("gold", "answer", "gold_rank", F.lit("16way").alias("task"))
        ax = scoring.compose_axes(model.score_axes_counts(model.fit_axes_counts(train, counts), ev, words=words)) \
            .select("gold", "answer", F.lit(None).cast("long").alias("gold_rank"), F.lit("axes").alias("task"))
        parts.append(materialize(p16.unionByName(ax).withColumn("variant", F.lit(v)), "variant-predictions"))
    pred = parts[0].unionByName(parts[1]).unionByName(parts[2])
    m = metrics.classification_metrics(pred, groups=["variant", "task"])
    return m.select("variant", "task", "n", "correct", "accuracy", "mean_match")


# --- streaming (R1-R4) -----------------------------------------------------------

def _run_stream(spark, utterances, sink_fn, change=transcript.running_transcript_stream, read=None):
    """The conversations arrive in three rounds (turn ranges, oldest first);
    after each round the stream runs on what is new and stops, so the next
    round resumes from its checkpoint."""
    root = scratch_path(spark, f"stream-{uuid.uuid4().hex}")
    schema = ", ".join(f"{c} {t}" for c, t in utterances.dtypes)
    for lo, hi in ((0, 1), (2, 3), (4, 1 << 30)):
        utterances.where((F.col("turn") >= lo) & (F.col("turn") <= hi)).write.mode("append").parquet(f"{root}/src")
        stream = change(transcript.read_utterances(spark, f"{root}/src", schema=schema))
        with transcript.bounded_run(spark):
            q = sink_fn(stream.writeStream.option("checkpointLocation", f"{root}/ckpt"), f"{root}/out")
        q.awaitTermination()
    return read(spark, f"{root}/out") if read else spark.read.parquet(f"{root}/out")


def _to_parquet(w, path):
    return w.format("parquet").trigger(availableNow=True).start(path)


@query("stream_transcript")
def q_stream_transcript(spark, base):
    """The streaming running transcript (R1); equals ``running_transcript``.
    Every prefix of a session is emitted: that is the operator."""
    out = _run_stream(spark, fx.utterances(spark, base), _to_parquet)
    return out.where("not late").select("session_id", "turn", "transcript")


@query("stream_stop")
def q_stream_stop(spark, base):
    """Sessions with a stop at every third turn (R3): the text starts anew."""
    u = fx.utterances(spark, base).withColumn("is_stop", F.col("turn") % 3 == 2)
    return _run_stream(spark, u, _to_parquet).where("not late").select("session_id", "turn", "transcript", "n_tokens")


#: tokens kept per session in the capped stream
STREAM_TOKENS = 20


@query("stream_capped")
def q_stream_capped(spark, base):
    """The stream with bounded state."""
    out = _run_stream(spark, fx.utterances(spark, base), _to_parquet,
                      lambda u: transcript.running_transcript_stream(u, max_tokens=STREAM_TOKENS))
    return out.where("not late").select("session_id", "turn", "transcript", "n_tokens")


@query("running_transcript_capped")
def q_running_transcript_capped(spark, base):
    """The batch twin of ``stream_capped``."""
    return sessions.running_transcript(fx.utterances(spark, base), max_tokens=STREAM_TOKENS)


@query("stream_top5")
def q_stream_top5(spark, base):
    """The text so far scored after every utterance by a model fitted on the
    training posts, its best five classes kept (R2, T3). Scores are kept up in
    state, so a turn costs its own words; every micro-batch is committed whole
    (S8)."""
    fitted = model.fit_buckets(_labelled_split(spark, base).where("split = 'train'"))

    def best(batch):
        return scoring.ranked_long(batch.where("not late"), id_col=("session_id", "turn", "n_tokens"), k=5)

    def sink(w, path):
        return w.foreachBatch(committed.committed_sink(best, path)).trigger(availableNow=True).start()

    out = _run_stream(spark, fx.utterances(spark, base), sink, lambda u: livescore.live_scores(u, fitted),
                      committed.read_committed)
    return out.select("session_id", "turn", "n_tokens", "rk", "name", F.round("p", 9).alias("p"))


def _variant_loader(spark, base):
    """All variants written once as membership (S2); returns a reader of one
    dataset (S3) as model input."""
    store = _variant_store(spark, base, posts_src.with_label(fx.posts(spark, base), spark))

    def load(v, split):
        return model.with_model_input(store.read(v, split)).withColumn("gold", T.normalize_label("type"))
    return load


@query("train_metrics_by_variant")
def q_train_metrics_by_variant(spark, base):
    """Train on each dataset variant, evaluate on its eval split, compare
    (M7, A17): one logistic fit per variant and task - a loop over three names
    on the driver, each fit a Spark job, both tasks on the same features - then
    one grouped aggregation."""
    load = _variant_loader(spark, base)
    parts = []
    for v in VARIANTS:
        train, ev = load(v, "train"), load(v, "eval")
        features = model.fit_features(train)
        ev = materialize(features.stages.transform(ev).select("post_id", "gold", "features"), "eval-features")
        with ThreadPoolExecutor(1) as beside:      # one task's optimizer steps beside the other's
            fitted = beside.submit(inheritable_thread_target(spark)(model.fit_16way), train, features=features)
            feats, models = model.fit_axes(train, features=features)
            m16 = fitted.result()
        features.data.unpersist()
        p16 = scoring.predictions(model.score_16way(m16, ev)) \
            .select("gold", "answer", "gold_rank", F.lit("16way").alias("task"))
        ax = scoring.compose_axes(model.score_axes(feats, models, ev)) \
            .select("gold", "answer", F.lit(None).cast("long").alias("gold_rank"), F.lit("axes").alias("task"))
        parts.append(p16.unionByName(ax).withColumn("variant", F.lit(v)))
    pred = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return metrics.classification_metrics(pred, groups=["variant", "task"])


@query("csv_round_trip")
def q_csv_round_trip(spark, base):
    """Posts written as headered CSV and read back in ranges (S1): quotes, commas and newlines inside whole texts survive, and
    ids follow from the content."""
    path = scratch_path(spark, f"posts-csv-{uuid.uuid4().hex}")
    posts_src.write_posts_csv(fx.posts(spark, base).select("posts", "type"), path)
    return posts_src.read_posts_csv(spark, path).select("post_id", "posts", "type")
