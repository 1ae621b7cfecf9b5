import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from leaksift import build_session

    session = build_session("tests", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                            spark__driver__memory="8g", spark__ui__showConsoleProgress="false",
                            spark__checkpoint__dir=str(tmp_path_factory.mktemp("checkpoints")))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def broadcasts(spark):
    """``with broadcasts() as sent``: what Spark's plans, as run, broadcast inside the block, but for the block's own small literals."""
    from contextlib import contextmanager

    def executions():
        listed = spark._jsparkSession.sharedState().statusStore().executionsList()
        return {listed.apply(i).executionId() for i in range(listed.size())}

    @contextmanager
    def watch():
        before, sent = executions(), []
        yield sent
        spark._jsc.sc().listenerBus().waitUntilEmpty()
        store = spark._jsparkSession.sharedState().statusStore()
        for execution in sorted(executions() - before):
            nodes = store.planGraph(execution).allNodes()
            sent += [nodes.apply(i).desc() for i in range(nodes.size()) if nodes.apply(i).name() == "BroadcastExchange"]

    return watch
