"""The recheck takes a document's text only along with evidence that must be found in it."""

from pyspark.sql import functions as F

from annalist import vocab
from annalist.operators import persons as pe
from annalist.operators import repair as rp


def test_texts_go_with_pronoun_statements_only(spark, monkeypatch):
    seen = []

    def judged(rows, *args, **kwargs):
        seen.append(rows)
        return judge(rows, *args, **kwargs)

    judge = rp.at.judge_evidence
    monkeypatch.setattr(rp.at, "judge_evidence", judged)
    lexicon = vocab.Lexicon(statement=("was",), sentence_end=".", clause_marks=".", pronoun_lead="^He ", dated_pronoun_lead="^He ", background=())
    text = "Anna was here today. He was there too."
    docs = spark.createDataFrame([(1, 5, "t", text), (2, 5, "t", text)], "document_id long, source_id long, title string, content_text string")
    evidence = spark.createDataFrame([(1, 1, 1, "Anna was here today."), (2, 2, 1, "He was there too."), (3, 3, 2, None), (4, 4, 2, "Bert met Anna.")],
                                     "evidence_id long, event_id long, document_id long, evidence_text string")
    events = spark.createDataFrame([(k, 1, "statement", False) for k in range(1, 5)], "event_id long, person_id long, event_type string, human_locked boolean")
    people = spark.createDataFrame([(1, "anna", True)], "person_id long, name string, enabled boolean").withColumn("deleted_at", F.lit(None).cast("timestamp"))
    sources = spark.createDataFrame([(5, "s")], "source_id long, name string")
    job = rp.recheck_attribution(evidence, events, docs, people, sources, pe.make_scope(people, None, None), lexicon=lexicon)
    assert sorted((r.evidence_id, r.content_text) for r in seen[0].collect()) == [(1, None), (2, text), (3, None), (4, None)]
    assert sorted(r.evidence_id for r in job.changes["evidence"].collect()) == [3, 4]
    assert job.report.first()["scanned_evidence"] == 4
