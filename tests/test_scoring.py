import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from papercorpus.functions.prompts import title_prompt
from papercorpus.operators import scoring
from papercorpus.plans.evaluate import evaluate, predict_splits

PAPERS = "id string, title string, abstract string"
ROWS = [(str(i), f"Title {i}", f"Words  of\nabstract number {i}") for i in range(10)]


def test_prompt_wording(spark):
    prompt = spark.range(1).select(title_prompt(F.lit("An\n abstract"), " Write  it: ")).first()[0]
    assert prompt.split("\n") == [
        "You are an expert scientific writing assistant.", "Write it:", "Rules:",
        "- Return only one title.", "- Do not include explanations or prefixes.",
        "- Keep it concise and specific.", "Abstract: An abstract", "Title:"]


def test_examples_are_the_same_for_every_row(spark):
    papers = spark.createDataFrame(ROWS, PAPERS)
    shots = scoring.few_shot_examples(papers, 3, 42, F.col("id"), max_chars=8)
    assert [r["number"] for r in shots.orderBy("number").collect()] == [1, 2, 3]
    assert all(len(r["abstract"]) == 8 for r in shots.collect())
    prompts = papers.select(title_prompt(F.col("abstract"), examples=scoring.example_block(shots)).alias("p"))
    blocks = {r["p"].split("Examples:\n")[1].split("\nAbstract: Words")[0] for r in prompts.collect()}
    assert len(blocks) == 1
    lines = blocks.pop().split("\n")
    assert [line.split(":")[0] for line in lines] == [
        f"Example {i} {part}" for i in (1, 2, 3) for part in ("Abstract", "Title")]
    assert lines[0].endswith(" Words o")


def test_no_shots_no_examples(spark):
    papers = spark.createDataFrame(ROWS, PAPERS)
    shots = scoring.few_shot_examples(papers, 0, 42, F.col("id"))
    assert shots.count() == 0
    prompt = papers.select(title_prompt(F.col("abstract"), examples=scoring.example_block(shots))).first()[0]
    assert "Example" not in prompt


def predicted(spark, make, **options):
    papers = spark.createDataFrame(ROWS, PAPERS).coalesce(1)
    return [r[0] for r in papers.select(scoring.predict(F.col("abstract"), make, **options)).collect()]


class Echo:
    def __init__(self):
        self.sizes = []

    def __call__(self, prompts):
        self.sizes.append(len(prompts))
        return [f"{self.sizes}" for _ in prompts]


def test_batches_and_one_set_up_per_task(spark):
    assert predicted(spark, Echo, batch_size=4)[-1] == "[4, 4, 2]"


class Flaky:
    """Fails its first calls."""

    def __init__(self, failures):
        self.left = failures

    def __call__(self, prompts):
        if self.left:
            self.left -= 1
            raise RuntimeError("busy")
        return prompts


def test_retries(spark):
    assert len(predicted(spark, lambda: Flaky(2), max_retries=2, retry_pause=0.0)) == 10
    with pytest.raises(PythonException, match="busy"):
        predicted(spark, lambda: Flaky(3), max_retries=2, retry_pause=0.0)


def test_answers_must_match_prompts(spark):
    with pytest.raises(PythonException, match="answers"):
        predicted(spark, lambda: lambda prompts: prompts[:1])


def test_evaluate_perfect_predictions(spark):
    rows = [(str(i), f"words of text number {i}", f"words of text number {i} and more", s)
            for i, s in enumerate(["train", "val", "test"] * 4)]
    papers = spark.createDataFrame(rows, PAPERS + ", split string")
    got = predict_splits(papers, lambda: scoring.LeadPredictor(5), num_shots=2)
    assert {r["mode"] for r in got.collect()} == {"few_shot"}
    assert got.filter("split = 'train'").count() == 0
    table = {(r["split"], r["metric"]): r["value"] for r in evaluate(got).collect()}
    for split in ("val", "test"):
        for metric, value in {"rouge1": 1, "rouge2": 1, "rougeL": 1, "bleu": 100, "exact_match_rate": 1,
                              "bertscore_failed": 1, "bertscore_f1": -1, "semantic_cosine_mean": -1}.items():
            assert table[(split, metric)] == pytest.approx(value)


def test_attached_predictions(spark):
    papers = spark.createDataFrame(ROWS, PAPERS)
    preds = spark.createDataFrame([("1", "x")], "id string, predicted_title string")
    got = {r["id"]: r["predicted_title"] for r in scoring.attach_predictions(papers, preds).collect()}
    assert got["1"] == "x" and got["2"] is None and len(got) == 10


def test_answers_once_given_are_kept():
    from papercorpus.operators.scoring import _answer

    asked = []

    def model(prompts):
        asked.append(len(prompts))
        if len(prompts) > 2:
            raise RuntimeError("too many")
        return [p.upper() for p in prompts]

    assert _answer(model, list("abcdefgh"), 2, 0.0) == list("ABCDEFGH")
    assert asked == [8, 4, 2, 2, 2, 2]


def test_a_repeated_prediction_is_an_error(spark):
    papers = spark.createDataFrame([("", "t"), ("", "u")], "id string, title string")
    one = spark.createDataFrame([("", "p")], "id string, predicted_title string")
    assert scoring.attach_predictions(papers, one).count() == 2
    with pytest.raises(Exception, match="not unique"):
        scoring.attach_predictions(papers, one.unionByName(one)).collect()
