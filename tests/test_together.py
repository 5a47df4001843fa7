import pyarrow as pa
import pytest

from triagework.models import together
from triagework.models.together import Together, message_folder, task_slots


@pytest.mark.parametrize("reachable", [True, False])
def test_all_tasks_hear_all_messages_in_order(spark, reachable):
    folder = message_folder(spark) if reachable else "hdfs://nowhere/messages"

    def run(batches):
        together.PIECE = 5
        others = Together(folder)
        list(batches)
        told = [others.tell(b"x" * (others.own * 4)), others.tell(b"" if others.own else b"first")]
        heard = [",".join(t.decode() for t in step) for step in told]
        yield pa.RecordBatch.from_pydict({"by_file": [others.by_file], "heard": ["|".join(heard)]})

    found = spark.range(0, 3, 1, 3).mapInArrow(run, "by_file boolean, heard string", barrier=True).collect()
    assert [tuple(r) for r in found] == [(reachable, ",xxxx,xxxxxxxx|first,,")] * 3


def test_slots(spark):
    assert task_slots(spark) == 4


def test_tasks_meet_twice_before_they_tell_each_other(spark):
    """Each message of the barrier takes a second."""
    folder = message_folder(spark)

    def run(batches):
        calls = []
        context = together.BarrierTaskContext
        gather, wait = context.allGather, context.barrier
        context.allGather = lambda self, message="": calls.append(1) or gather(self, message)
        context.barrier = lambda self: calls.append(1) or wait(self)
        try:
            others = Together(folder)
            list(batches)
            others.tell(b"x")
        finally:
            context.allGather, context.barrier = gather, wait
        yield pa.RecordBatch.from_pydict({"calls": [len(calls)]})

    assert [r.calls for r in spark.range(0, 2, 1, 2).mapInArrow(run, "calls long", barrier=True).collect()] == [2, 2]
