import pytest

from triagework import jobs
from triagework.models import priority
from triagework.models.saved import save_model
from triagework.plans.preprocess import read_vocabulary, transform_texts
from triagework.sources import queues

HEADER = (
    "Ticket_Subject,Ticket_Description,Issue_Category,Ticket_Channel,Priority_Level,Submission_Date,"
    "Resolution_Time_Hours\n"
)
LABELS = {"Critical": "outage down", "High": "payment failed", "Low": "profile question", "Medium": "slow page"}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    folder = tmp_path_factory.mktemp("root")
    (folder / "data").mkdir()
    lines = [
        f'{words},"{words}, ticket {n}",Billing,Email,{label},2024-01-0{1 + n % 9},{5 + n % 20}\n'
        for n in range(40)
        for label, words in LABELS.items()
    ]
    (folder / "data" / "customer_support_tickets.csv").write_text(HEADER + "".join(lines))
    batch = ["Ticket_Subject,Ticket_Description,Issue_Category", 'payment failed,"payment failed, again",Fraud']
    (folder / "batch.csv").write_text("\n".join([*batch, "slow page,slow page,"]) + "\n")
    return str(folder)


def test_inspect_and_preprocess(spark, root, capsys):
    jobs.main(["--root", root, "inspect"])
    assert "median" in capsys.readouterr().out
    jobs.main(["--root", root, "preprocess"])
    labels = spark.read.parquet(f"{root}/data/processed/labels")
    assert {r.split: r["count"] for r in labels.groupBy("split").count().collect()} == {"train": 128, "test": 32}
    assert spark.read.parquet(f"{root}/data/processed/label_mapping").count() == 4
    features = spark.read.parquet(f"{root}/data/processed/features").where("ticket_key is not null")
    assert features.count() == 160
    assert spark.read.parquet(f"{root}/data/processed/tfidf").where("weight > 1").count() == 0
    vocabulary = read_vocabulary(spark, f"{root}/data/processed/vocabulary")
    again = transform_texts(jobs.history(spark, root), vocabulary)
    assert again.exceptAll(features.select(again.columns)).count() == 0


def test_repeated_rows_have_keys_of_their_own(spark, tmp_path):
    (tmp_path / "data").mkdir()
    (tmp_path / "data" / "customer_support_tickets.csv").write_text(HEADER + "s,d,Billing,Email,Low,2024-01-01,5\n" * 9)
    assert jobs.history(spark, str(tmp_path)).select("ticket_key").distinct().count() == 9


def test_train_batch_and_queues(spark, root, capsys):
    with pytest.raises(SystemExit):
        jobs.main(["--root", root, "batch", f"{root}/batch.csv", f"{root}/out"])
    jobs.main(["--root", root, "train", "forest"])
    assert "rmse" in capsys.readouterr().out
    model, _ = priority.train_boosted(jobs.history(spark, root), priority.boosted_learner(rounds=2, depth=2))
    save_model(model.pipeline, f"{root}/models/boosted")
    jobs.main(["--root", root, "batch", f"{root}/batch.csv", f"{root}/out"])
    queued = {r.Ticket_Description: r for r in queues.read_queues(spark, f"{root}/queues").collect()}
    assert queued["payment failed, again"].Priority == "High"
    assert queued["payment failed, again"].Routed_Department == "Fraud & Risk"
    assert queued["slow page"].Issue_Category is None
    assert queued["slow page"].Routed_Department == "General Support"
    jobs.main(["--root", root, "queues"])
    assert "Queue_No" in capsys.readouterr().out
