"""Tasks of one barrier stage that run side by side and tell each other what they found.

A step of an iterative fit is then an exchange of some milliseconds between running tasks, not a Spark job. Messages are
small files in the folder that all executors share. Where the tasks do not see each other's files there, they use the
barrier's own messages, which take a second each.
"""

import base64
import os
import time
import uuid
from urllib.parse import urlparse

from pyspark import BarrierTaskContext
from pyspark.sql import SparkSession

from triagework.session import new_output_dir

#: Bytes that a task sends at once as a message of the barrier.
PIECE = 1 << 20


def task_slots(spark: SparkSession) -> int:
    """Tasks that the executors run at once; 0 where executors come and go, as barrier stages are not allowed there."""
    if spark.conf.get("spark.dynamicAllocation.enabled", "false").lower() == "true":
        return 0
    context = spark.sparkContext._jsc.sc()
    return context.maxNumConcurrentTasks(context.resourceProfileManager().defaultResourceProfile())


def message_folder(spark: SparkSession) -> str:
    """A new folder for messages, which goes when the session ends."""
    path = new_output_dir(spark, "messages")
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(place)
    return path


class Together:
    """The running task's link to the others of its stage; all of them make the same calls in the same order."""

    def __init__(self, folder: str) -> None:
        self.context = BarrierTaskContext.get()
        self.own, self.tasks, self.step = self.context.partitionId(), len(self.context.getTaskInfos()), 0
        where = urlparse(folder)
        # Each run of the stage has a folder of its own. A message of the barrier takes a second, so there are two only.
        own = uuid.uuid4().hex
        probes = where.path if where.scheme in ("", "file") else ""
        if probes:
            os.makedirs(probes, exist_ok=True)
            with open(os.path.join(probes, own), "wb"):
                pass
        names = self.context.allGather(own)
        self.folder = os.path.join(probes, names[0] + "-run") if probes else ""
        seen = bool(probes) and all(os.path.exists(os.path.join(probes, name)) for name in names)
        if seen:
            os.makedirs(self.folder, exist_ok=True)
            self.write(b"")
        self.by_file = all(told == "yes" for told in self.context.allGather("yes" if seen else "no"))

    def place(self, task: int, step: int | None = None) -> str:
        return os.path.join(self.folder, f"{self.step if step is None else step}-{task}")

    def write(self, payload: bytes) -> None:
        """A message appears whole, under its name."""
        with open(f"{self.place(self.own)}.part", "wb") as out:
            out.write(payload)
        os.replace(f"{self.place(self.own)}.part", self.place(self.own))

    def read(self, task: int) -> bytes:
        """The task's message of this step, once it is there; a task that fails ends the whole stage."""
        pause = 0.0005
        while True:
            try:
                with open(self.place(task), "rb") as told:
                    return told.read()
            except FileNotFoundError:
                time.sleep(pause)
                pause = min(2 * pause, 0.002)

    def tell(self, payload: bytes) -> list[bytes]:
        """The payloads of all tasks, in the order of the tasks."""
        if not self.by_file:
            return self.tell_by_messages(payload)
        self.step += 1
        self.write(payload)
        told = [payload if task == self.own else self.read(task) for task in range(self.tasks)]
        # Whoever has written this step's message has read those of the last.
        os.remove(self.place(self.own, self.step - 1))
        return told

    def tell_by_messages(self, payload: bytes) -> list[bytes]:
        texts = [base64.b64encode(payload[at : at + PIECE]).decode() for at in range(0, len(payload), PIECE)] or [""]
        first = [t.split(" ") for t in self.context.allGather(f"{len(texts)} {texts[0]}")]
        told = [[text] for _, text in first]
        for at in range(1, max(int(count) for count, _ in first)):
            for own, text in zip(told, self.context.allGather(texts[at] if at < len(texts) else ""), strict=True):
                own.append(text)
        return [b"".join(base64.b64decode(t) for t in own) for own in told]
