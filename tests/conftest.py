import os
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    conf = {
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.sql.session.timeZone": "UTC",
        "spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('shared')}", "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
    }
    session = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def _git(repo, *args, date="2020-01-01"):
    when = f"{date}T00:00:00+00:00"
    env = os.environ | {"GIT_AUTHOR_DATE": when, "GIT_COMMITTER_DATE": when, "GIT_CONFIG_GLOBAL": "/dev/null", "GIT_CONFIG_SYSTEM": "/dev/null"}
    subprocess.run(["git", "-C", str(repo), "-c", "user.name=t", "-c", "user.email=t@example.invalid", *args], check=True, capture_output=True, env=env)


FIRST = '''"""Core."""
import os
LIMIT = 3

def parse_line(line):
    parts = line.split(":")
    return parts[0], parts[1]

class Client:
    """Keeps a connection."""
    def open(self):
        return connect_socket(self.host)

    def close(self):
        return shutdown_socket(self.host)

if __name__ == "__main__":
    parse_line("a:b")
'''


@pytest.fixture(scope="session")
def repo(tmp_path_factory):
    """Three tags: a first state; one function edited, a file added and one deleted; a file moved."""
    path = tmp_path_factory.mktemp("repo")
    _git(path, "init", "-q", "-b", "main")
    (path / "core.py").write_text(FIRST)
    (path / "old.py").write_text("print 'two'\n")
    (path / "README.md").write_text("# demo\n\ntext\n")
    (path / "logo.png").write_bytes(b"\x89PNG\0")
    for tag, date, change in (
        ("r1", "2020-01-01", lambda: None),
        ("r2", "2021-01-01", lambda: ((path / "core.py").write_text(FIRST.replace('split(":")', 'split("=")')), (path / "wait.py").write_text("def backoff_delay(attempt):\n    return 2 ** attempt\n"), (path / "README.md").unlink())),
        ("r3", "2022-01-01", lambda: ((path / "src").mkdir(), (path / "core.py").rename(path / "src" / "core.py"))),
    ):
        change()
        _git(path, "add", "-A", date=date)
        _git(path, "commit", "-q", "-m", tag, date=date)
        _git(path, "tag", tag, date=date)
    return str(path)
