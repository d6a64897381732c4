"""Trained and pluggable models: classifiers, perplexity, language, embeddings, text services.

Nothing here downloads weights.  Where a pretrained model was expected, a model
of the same contract is trained from the table, or a backend is passed in.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression, NaiveBayes, OneVsRest
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import HashingTF, IndexToString, NGram, RegexTokenizer, SQLTransformer, StringIndexer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.functions.templates import fields_of, rendered
from loomwright.functions.text import chained, classifier_text
from loomwright.operators.frame import hash_split
from loomwright.plans.lineage import cut_lineage


def train_text_classifier(
    df: DataFrame, field: str, label: str, id_col: str, path: str | None = None, features: int = 1 << 16, seed: int = 42, penalties: Sequence[float] = (0.0, 0.01)
) -> tuple[PipelineModel, float]:
    """(model, accuracy on the test split): logistic regression over word uni- and bigrams.

    Of several ``penalties`` the one that does best on a validation split of the
    training rows is taken, and the model is fitted with it on all of these.
    """
    rows = hash_split(df.where(F.col(label).isNotNull() & F.col(field).isNotNull()), id_col, 0.1, 0.1, seed).withColumn("__text", classifier_text(F.col(field)))
    train, test = rows.where("split <> 'test'"), rows.where("split = 'test'")
    indexer = StringIndexer(inputCol=label, outputCol="__label", handleInvalid="skip").fit(train)
    words = [
        indexer, RegexTokenizer(inputCol="__text", outputCol="__words", pattern=r"\s+"), NGram(n=2, inputCol="__words", outputCol="__pairs"),
        SQLTransformer(statement="SELECT *, concat(__words, __pairs) AS __terms FROM __THIS__"),
        HashingTF(inputCol="__terms", outputCol="__features", numFeatures=features),
    ]
    judge = MulticlassClassificationEvaluator(labelCol="__label", predictionCol="__prediction", metricName="accuracy")
    ready = cut_lineage(PipelineModel(words).transform(train).select("__label", "__features", "split"))
    fit = lambda part, penalty: LogisticRegression(featuresCol="__features", labelCol="__label", predictionCol="__prediction", maxIter=20, regParam=penalty).fit(part)
    best = penalties[0]
    if len(penalties) > 1 and ready.where("split = 'validation'").limit(1).count():
        best = max(penalties, key=lambda penalty: judge.evaluate(fit(ready.where("split = 'train'"), penalty).transform(ready.where("split = 'validation'"))))
    model = PipelineModel([*words, fit(ready, best), IndexToString(inputCol="__prediction", outputCol="predicted", labels=indexer.labels)])
    accuracy = judge.evaluate(model.transform(test))
    if path:
        model.write().overwrite().save(path)
    return model, float(accuracy)


def classify_text(df: DataFrame, model: PipelineModel | str, field: str, new_column: str) -> DataFrame:
    model = PipelineModel.load(model) if isinstance(model, str) else model
    stages = PipelineModel([s for s in model.stages if not hasattr(s, "labelsArray") or s.getOutputCol() == "predicted"])
    out = stages.transform(df.withColumn("__text", F.coalesce(classifier_text(F.col(field)), F.lit(""))))
    return out.select(*df.columns, F.col("predicted").alias(new_column))


def train_embedding_classifier(df: DataFrame, vector_col: str, label: str, id_col: str, model_type: str = "logistic", path: str | None = None, seed: int = 42) -> tuple[PipelineModel, float]:
    """(model, accuracy on the test split); ``svm`` or ``logistic`` (also ``logistic_regression``)."""
    if model_type not in ("svm", "logistic", "logistic_regression"):
        raise ValueError("model_type must be svm or logistic")
    rows = hash_split(df.where(F.col(label).isNotNull()), id_col, 0.0, 0.1, seed).withColumn("__features", array_to_vector(F.col(vector_col).cast("array<double>")))
    train, test = rows.where("split <> 'test'"), rows.where("split = 'test'")
    indexer = StringIndexer(inputCol=label, outputCol="__label", handleInvalid="skip").fit(train)
    columns = {"featuresCol": "__features", "labelCol": "__label", "predictionCol": "__prediction"}
    classifier = LogisticRegression(**columns) if model_type != "svm" else OneVsRest(classifier=LinearSVC(featuresCol="__features", labelCol="__label"), **columns)
    model = Pipeline(stages=[indexer, classifier, IndexToString(inputCol="__prediction", outputCol="predicted", labels=indexer.labels)]).fit(train)
    accuracy = MulticlassClassificationEvaluator(labelCol="__label", predictionCol="__prediction", metricName="accuracy").evaluate(model.transform(test))
    if path:
        model.write().overwrite().save(path)
    return model, float(accuracy)


def classify_embeddings(df: DataFrame, model: PipelineModel | str, vector_col: str, new_column: str) -> DataFrame:
    model = PipelineModel.load(model) if isinstance(model, str) else model
    out = PipelineModel(model.stages[1:]).transform(df.withColumn("__features", array_to_vector(F.col(vector_col).cast("array<double>"))))
    return out.select(*df.columns, F.col("predicted").alias(new_column))


def _trigrams(text):
    """Three-character sequences of the lower-case words, blanks between; none where there is no letter."""
    padded = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"\P{L}+", " "), F.lit(" "))
    return F.when(F.rlike(text, F.lit(r"\p{L}")), F.regexp_extract_all(padded, F.lit("(?=(...))"), 1)).otherwise(F.array().cast("array<string>"))


def train_language_detector(samples: DataFrame, field: str, label: str, features: int = 1 << 15) -> PipelineModel:
    """Naive Bayes over character trigrams of texts of known language."""
    rows = samples.where(F.col(label).isNotNull() & F.col(field).isNotNull()).withColumn("__grams", _trigrams(F.col(field)))
    indexer = StringIndexer(inputCol=label, outputCol="__label", stringOrderType="alphabetAsc").fit(rows)
    stages = [
        HashingTF(inputCol="__grams", outputCol="__features", numFeatures=features),
        NaiveBayes(featuresCol="__features", labelCol="__label", predictionCol="__prediction", smoothing=0.1),
        IndexToString(inputCol="__prediction", outputCol="predicted", labels=indexer.labels),
    ]
    return PipelineModel(Pipeline(stages=stages).fit(indexer.transform(rows)).stages)


def detect_language(df: DataFrame, model: PipelineModel, field: str, new_column: str = "__language") -> DataFrame:
    """The likeliest language of every row; null where the text is null or has no letter."""
    out = model.transform(df.withColumn("__grams", _trigrams(F.col(field))))
    return out.select(*df.columns, F.when(F.size("__grams") > 0, F.col("predicted")).alias(new_column))


def words_of(text):
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def unigram_perplexity(df: DataFrame, id_col: str, field: str) -> DataFrame:
    """``(id, words, perplexity)``: 10 ** (-mean log10 p) under add-one word frequencies of the whole table.

    Words are counted map-side before they are shuffled.  The table of words is
    written once: where it is small it goes to the texts by its true size, and
    these are not shuffled.  Texts without words have null.
    """
    words = df.select(F.col(id_col), F.explode(words_of(F.col(field))).alias("word"))
    total = words.groupBy("word").agg(F.count("*").alias("f"))
    size = total.agg(F.sum("f").alias("all"), F.count("*").alias("kinds"))
    logs = total.crossJoin(F.broadcast(size)).select("word", F.log10((F.col("f") + 1) / (F.col("all") + F.col("kinds"))).alias("lp"))  # one row on the right
    scored = words.join(cut_lineage(logs), "word").groupBy(id_col).agg(F.count("*").alias("words"), F.sum("lp").alias("s"))
    return df.select(id_col).join(scored, id_col, "left").select(id_col, F.coalesce("words", F.lit(0)).alias("words"), F.round(F.pow(F.lit(10.0), -F.col("s") / F.col("words")), 1).alias("perplexity"))


class ArpaModel:
    """An n-gram language model in the ARPA format, scored with back-off; one line holds log10 probability, words and log10 back-off."""

    def __init__(self, lines: Iterable[str]) -> None:
        self.grams: dict[tuple[str, ...], tuple[float, float]] = {}
        order = 0
        for line in lines:
            line = line.rstrip("\n")
            if line.startswith("\\"):
                order = int(line[1:].partition("-")[0]) if "-grams:" in line else 0
            elif order and line.strip():
                parts = line.split("\t") if "\t" in line else line.split()
                words = parts[1].split() if "\t" in line else parts[1 : 1 + order]
                rest = parts[2:] if "\t" in line else parts[1 + order :]
                self.grams[tuple(words)] = (float(parts[0]), float(rest[0]) if rest else 0.0)
        self.order = max(map(len, self.grams), default=0)

    @classmethod
    def load(cls, path: str) -> ArpaModel:
        with open(path, encoding="utf-8") as lines:
            return cls(lines)

    def _word(self, context: tuple[str, ...], word: str) -> float:
        back = 0.0
        while True:
            found = self.grams.get((*context, word))
            if found is not None:
                return back + found[0]
            if not context:
                return back + self.grams.get(("<unk>",), (-100.0, 0.0))[0]
            back += self.grams.get(context, (0.0, 0.0))[1]
            context = context[1:]

    def perplexity(self, text: str) -> float:
        """10 ** (-mean log10 probability), the end of the sentence included."""
        words = [*text.split(), "</s>"]
        known = [w if (w,) in self.grams else "<unk>" for w in words]
        path = ["<s>", *known]
        total = sum(self._word(tuple(path[max(0, i - self.order + 2) : i + 1]), known[i]) for i in range(len(known)))
        return 10.0 ** (-total / len(known))


def arpa_perplexity(df: DataFrame, field: str, new_column: str, path: str, prepare: Callable[[str], str] | None = None) -> DataFrame:
    """``new_column``: perplexity by an ARPA file that every executor can read, loaded once per worker; null for null.

    ``prepare`` may cut a text into the model's pieces, joined by blanks.
    """

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = ArpaModel.load(path)
        for batch in batches:
            yield batch.map(lambda t: model.perplexity(prepare(t) if prepare else t), na_action="ignore").astype(float)

    return df.withColumn(new_column, run(F.col(field)))


def write_arpa_bigrams(df: DataFrame, field: str, path: str) -> None:
    """A bigram model of a text column (absolute discounting by a half), written on the driver: its size is that of the vocabulary and its pairs."""
    words = df.where(F.col(field).isNotNull()).select(F.concat(F.array(F.lit("<s>")), F.filter(F.split(F.trim(field), r"\s+"), lambda w: w != ""), F.array(F.lit("</s>"))).alias("w"))
    pairs = words.select(F.explode(F.expr("transform(sequence(1, size(w) - 1), i -> struct(w[i - 1] as a, w[i] as b))")).alias("p")).groupBy("p.a", "p.b").count()
    own: dict[str, dict[str, int]] = {}
    for a, b, n in pairs.toLocalIterator():
        own.setdefault(a, {})[b] = n
    single: dict[str, int] = {}
    for nexts in own.values():
        for b, n in nexts.items():
            single[b] = single.get(b, 0) + n
    total = sum(single.values()) + len(single) + 1
    with open(path, "w", encoding="utf-8") as out:
        print(f"\\data\\\nngram 1={len(single) + 2}\nngram 2={sum(map(len, own.values()))}\n\n\\1-grams:", file=out)
        print(f"{math.log10(1 / total)}\t<unk>\t0.0", file=out)
        for w in sorted({*single, "<s>"}):
            back = 0.5 * len(own[w]) / sum(own[w].values()) if w in own else 1.0
            print(f"{math.log10((single.get(w, 0) + 1) / total)}\t{w}\t{math.log10(back)}", file=out)
        print("\n\\2-grams:", file=out)
        for a in sorted(own):
            size = sum(own[a].values())
            for b, n in sorted(own[a].items()):
                low = 0.5 * len(own[a]) / size * (single[b] + 1) / total
                print(f"{math.log10((n - 0.5) / size + low)}\t{a} {b}", file=out)
        print("\n\\end\\", file=out)


class EmbeddingBackend(Protocol):
    def load(self) -> None: ...
    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashedEmbedding:
    """A backend without weights: hashed words, each a fixed random direction, averaged."""

    def __init__(self, dim: int = 64) -> None:
        self.dim = dim

    def load(self) -> None:
        self._known: dict[str, np.ndarray] = {}

    def embed(self, texts: list[str]) -> np.ndarray:
        import zlib

        out = np.zeros((len(texts), self.dim))
        for i, text in enumerate(texts):
            for word in text.lower().split():
                if word not in self._known:
                    self._known[word] = np.random.default_rng(zlib.crc32(word.encode())).normal(size=self.dim)
                out[i] += self._known[word]
        return out


BACKENDS: dict[str, type] = {"hashed": HashedEmbedding}


def embedding_backend(name: str, **options) -> EmbeddingBackend:
    if name not in BACKENDS:
        raise ValueError(f"unknown backend {name!r}; known: {sorted(BACKENDS)}")
    return BACKENDS[name](**options)


def split_tokens(tokens: Sequence, most: int = 512, strategy: str = "even") -> list[Sequence]:
    """``truncate``: the first chunk; ``greedy``: full chunks; ``even``: chunks that differ by one token at most."""
    if strategy not in ("truncate", "greedy", "even"):
        raise ValueError("strategy must be truncate, greedy or even")
    n = len(tokens)
    if n <= most or strategy == "truncate":
        return [tokens[:most]]
    if strategy == "greedy":
        return [tokens[i : i + most] for i in range(0, n, most)]
    parts = -(-n // most)
    cuts = np.cumsum([0] + [n // parts + (k < n % parts) for k in range(parts)])
    return [tokens[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


def with_embeddings(df: DataFrame, field: str, backend: EmbeddingBackend, new_column: str = "__embedding", normalize: bool = False, split_strategy: str = "even", most: int = 512, at_once: int = 256) -> DataFrame:
    """``new_column``: the mean of the chunks' vectors, weighted by their words; null for null.

    The model is loaded once per worker and asked for up to ``at_once`` chunks of a batch of texts together.
    """
    if new_column in df.columns:
        raise ValueError(f"{new_column} exists")

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        backend.load()
        for batch in batches:
            # the chunks of all texts of a batch go to the backend together, in order of their length
            parts = [None if text is None else split_tokens(text.split() or [""], most, split_strategy) for text in batch]
            flat = [(i, chunk) for i, own in enumerate(parts) for chunk in own or ()]
            flat.sort(key=lambda x: len(x[1]))
            owner = np.array([i for i, _ in flat], dtype=np.int64)
            weight = np.array([len(chunk) for _, chunk in flat], dtype=float)
            vectors = [backend.embed([" ".join(chunk) for _, chunk in flat[k : k + at_once]]) for k in range(0, len(flat), at_once)]
            out: list = [None] * len(batch)
            if vectors:
                x = np.concatenate(vectors)
                sums, sizes = np.zeros((len(batch), x.shape[1])), np.zeros(len(batch))
                np.add.at(sums, owner, x * weight[:, None])
                np.add.at(sizes, owner, weight)
                for i in np.unique(owner):
                    v = sums[i] / sizes[i]
                    out[i] = v / max(np.linalg.norm(v), 1e-12) if normalize else v
            yield pd.Series(out)

    return df.withColumn(new_column, run(F.col(field)))


class SessionEmbedding:
    """A backend over a local inference session: ``make`` gives ``(encode, run)`` once per worker.

    ``encode`` turns a text into token ids, ``run`` a padded batch of ids and
    its mask into one vector for each token; the tokens' mean is the vector of
    the text.  :func:`onnx_session` makes the pair for an ONNX model.
    """

    def __init__(self, make: Callable[[], tuple[Callable[[str], list[int]], Callable[[np.ndarray, np.ndarray], np.ndarray]]], most: int = 512) -> None:
        self.make, self.most = make, most

    def load(self) -> None:
        self._encode, self._run = self.make()

    def embed(self, texts: list[str]) -> np.ndarray:
        ids = [self._encode(t)[: self.most] or [0] for t in texts]
        width = max(map(len, ids))
        padded = np.array([own + [0] * (width - len(own)) for own in ids], dtype=np.int64)
        mask = np.array([[1] * len(own) + [0] * (width - len(own)) for own in ids], dtype=np.int64)
        hidden = np.asarray(self._run(padded, mask), dtype=np.float64)
        return (hidden * mask[:, :, None]).sum(1) / mask.sum(1, keepdims=True)


def onnx_session(model_path: str, tokenizer_path: str) -> tuple[Callable, Callable]:
    """For :class:`SessionEmbedding`, of files that every executor can read; needs onnxruntime and tokenizers."""
    import onnxruntime
    from tokenizers import Tokenizer

    options = onnxruntime.SessionOptions()
    options.intra_op_num_threads = 1  # one core a task
    session = onnxruntime.InferenceSession(model_path, options)
    tokenizer = Tokenizer.from_file(tokenizer_path)
    wanted = {i.name for i in session.get_inputs()}

    def run(ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
        given = {"input_ids": ids, "attention_mask": mask, "token_type_ids": np.zeros_like(ids)}
        return session.run(None, {k: v for k, v in given.items() if k in wanted})[0]

    return lambda text: tokenizer.encode(text).ids, run


class ServiceEmbedding:
    """A backend over a remote service: ``post`` sends a batch of texts and returns their vectors, or raises."""

    def __init__(self, post: Callable[[list[str]], list[list[float]]], batch: int = 64, attempts: int = 3, pause: float = 1.0) -> None:
        self.post, self.batch, self.attempts, self.pause = post, batch, attempts, pause

    def load(self) -> None:
        pass

    def embed(self, texts: list[str]) -> np.ndarray:
        out: list[list[float]] = []
        for i in range(0, len(texts), self.batch):
            for attempt in range(self.attempts):
                try:
                    out += self.post(texts[i : i + self.batch])
                    break
                except Exception:
                    if attempt == self.attempts - 1:
                        raise
                    time.sleep(self.pause * 2**attempt)
        return np.array(out, dtype=np.float64)


BACKENDS |= {"session": SessionEmbedding, "service": ServiceEmbedding}


class TextBackend(Protocol):
    """A service that answers prompts; ``choices`` limits the answers. None is a failed request.

    It may raise :class:`RateLimited` where the service asks for a pause.
    """

    def answer(self, prompts: list[str], choices: Sequence[str] | None = None) -> list[str | None]: ...


class RateLimited(Exception):
    """The service wants a pause; nothing was answered."""


class KeywordBackend:
    """A stand-in without a service: the first choice whose rule's words occur after the first blank line, else the last choice.

    Without choices it repeats what stands after the blank line.
    """

    def __init__(self, rules: dict[str, Sequence[str]] | None = None) -> None:
        self.rules = rules or {}

    def answer(self, prompts: list[str], choices: Sequence[str] | None = None) -> list[str | None]:
        texts = [p.partition("\n\n")[2] for p in prompts]
        if not choices:
            return texts
        return [next((c for c in choices if any(w in t for w in self.rules.get(c, ()))), choices[-1]) for t in texts]


class RequestBudget:
    """Requests and tokens of the last minute, for one worker: :meth:`wait` sleeps until both limits allow more."""

    def __init__(self, requests_per_minute: float | None, tokens_per_minute: float | None, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        self.limits = (requests_per_minute, tokens_per_minute)
        self.clock, self.sleep = clock, sleep
        self.left = [x or 0.0 for x in self.limits]
        self.at = clock()

    def wait(self, requests: int, tokens: int) -> None:
        while True:
            now = self.clock()
            passed, self.at = now - self.at, now
            late = 0.0
            for i, (limit, need) in enumerate(zip(self.limits, (requests, tokens))):
                if limit:
                    self.left[i] = min(limit, self.left[i] + limit * passed / 60)
                    late = max(late, (min(need, limit) - self.left[i]) * 60 / limit)
            if late <= 1e-9:
                break
            self.sleep(late)
        for i, need in enumerate((requests, tokens)):
            if self.limits[i]:
                self.left[i] -= min(need, self.limits[i])


@dataclass(frozen=True)
class RequestSettings:
    """How a service is asked.

    Rates are meant per task: divide a global limit by the tasks that run at
    once.  Up to ``at_once`` batches of a task are under way together; tokens
    are taken as a quarter of the characters.  After :class:`RateLimited` a task
    pauses and asks again, which costs no attempt.
    """

    attempts: int = 3
    requests_per_minute: float | None = None
    tokens_per_minute: float | None = None
    batch_rows: int = 64
    at_once: int = 4
    pause: float = 15.0
    most_pauses: int = 20


def _ask(prompts: list[str], backend: TextBackend, choices: Sequence[str] | None, s: RequestSettings, budget: RequestBudget) -> list[str | None]:
    """The answers to some prompts, in their order."""
    answers: list[str | None] = [None] * len(prompts)
    waiting, pauses = list(range(len(prompts))), 0
    for _ in range(s.attempts):
        todo, failed = [waiting[k : k + s.batch_rows] for k in range(0, len(waiting), s.batch_rows)], []
        with ThreadPoolExecutor(s.at_once) as pool:
            while todo:
                under_way = []
                for rows in todo[: s.at_once]:
                    own = [prompts[i] for i in rows]
                    budget.wait(len(own), sum(map(len, own)) // 4)
                    under_way.append((rows, pool.submit(backend.answer, own, choices)))
                todo = todo[s.at_once :]
                for rows, reply in under_way:
                    try:
                        for i, a in zip(rows, reply.result()):
                            answers[i] = a
                            if a is None:
                                failed.append(i)
                    except RateLimited:
                        pauses += 1
                        if pauses > s.most_pauses:
                            failed += rows
                        else:
                            budget.sleep(s.pause)
                            todo.append(rows)
        waiting = failed
        if not waiting:
            break
    return answers


def answered(df: DataFrame, prompt_col: str, new_column: str, backend: TextBackend, choices: Sequence[str] | None = None, settings: RequestSettings = RequestSettings()) -> DataFrame:
    """``new_column``: the backend's answers, asked in batches with retries, rates and pauses; null for failed requests.

    Null prompts are not sent.  Write the result down before it is used twice.
    """
    schema = df.drop(new_column).withColumn(new_column, F.lit(None).cast("string")).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        budget = RequestBudget(settings.requests_per_minute, settings.tokens_per_minute)
        for batch in batches:
            answers: list[str | None] = [None] * len(batch)
            asked = [i for i, p in enumerate(batch[prompt_col]) if isinstance(p, str)]
            for i, a in zip(asked, _ask([batch[prompt_col].iloc[i] for i in asked], backend, choices, settings, budget)):
                answers[i] = a
            yield batch.assign(**{new_column: answers})[schema.names]

    return df.drop(new_column).mapInPandas(run, schema)


def ai_column(df: DataFrame, new_column: str, prompt: str, depends_on: Sequence[str], backend: TextBackend, normalize: Sequence[str] = ("strip",)) -> DataFrame:
    """A column of answers to a template over ``depends_on``; a failed request is the empty string."""
    if missing := [c for c in depends_on if c not in df.columns]:
        raise ValueError(f"unknown columns: {missing}")
    if new_column in df.columns:
        raise ValueError(f"{new_column} exists")
    out = answered(df.withColumn("__prompt", rendered(prompt, depends_on)), "__prompt", new_column, backend).drop("__prompt")
    return out.withColumn(new_column, chained(F.coalesce(new_column, F.lit("")), normalize))


def ai_tagger(df: DataFrame, field: str, tags: dict[str, str] | Sequence[str], backend: TextBackend, allow_not_sure: bool = False) -> DataFrame:
    """``__ai_tag__<tag>``: True, False (or Not sure) as strings, null for a failed request."""
    described = tags if isinstance(tags, dict) else {t: t for t in tags}
    choices = ["True", "False", *(["Not sure"] if allow_not_sure else [])]
    for tag, meaning in described.items():
        prompt = f"Does the tag {tag} ({meaning}) apply to this text? {' / '.join(choices)}\n\n{{{{{field}}}}}"
        df = answered(df.withColumn("__prompt", rendered(prompt, [field])), "__prompt", f"__ai_tag__{tag.replace(' ', '_')}", backend, choices).drop("__prompt")
    return df


def ai_classifier(df: DataFrame, new_column: str, field: str, classes: dict[str, str] | Sequence[str], backend: TextBackend) -> DataFrame:
    """One of the classes for each row, null for a failed request."""
    described = classes if isinstance(classes, dict) else {c: c for c in classes}
    prompt = "Classify the text as one of: " + "; ".join(f"{c}: {d}" for c, d in described.items()) + f"\n\n{{{{{field}}}}}"
    return answered(df.withColumn("__prompt", rendered(prompt, [field])), "__prompt", new_column, backend, list(described)).drop("__prompt")


def ai_label_clusters(df: DataFrame, examples: DataFrame, cluster_col: str, new_column: str, context: Sequence[str], backend: TextBackend, prompt: str = "Name what these have in common:\n{{examples}}") -> DataFrame:
    """One label per cluster from a bounded number of example rows (``cluster``, ``rank``, context), joined to all rows; noise has null."""
    template = " | ".join(f"{{{{{c}}}}}" for c in context)
    fields_of(template)
    lines = examples.select("cluster", F.struct("rank", rendered(template, context).alias("line")).alias("x"))
    gathered = lines.groupBy("cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("examples"))
    labels = answered(gathered.withColumn("__prompt", rendered(prompt, ["examples"])), "__prompt", new_column, backend).select(F.col("cluster").alias(cluster_col), new_column)
    return df.join(labels, cluster_col, "left")
