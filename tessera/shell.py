"""``python -m tessera.shell ROOT``: statements from the terminal or a pipe.

Options: ``--batch`` (read standard input to its end), ``--no-prompt``, ``--test-mode``
(repeat statements, no times), ``--timestamp-format=usecs`` (times as plain numbers,
which are nanoseconds whatever the option's name says).
"""

from __future__ import annotations

import subprocess
import sys
import time

from .dialect import split_statements
from .errors import TableError
from .session import Session

META = "quit, exit; print TEXT; source FILE or . FILE; system COMMAND or \\! COMMAND; status; pause SECONDS; help"


class Shell:
    def __init__(self, session: Session, out=sys.stdout, test_mode: bool = False):
        self.session, self.out, self.test_mode = session, out, test_mode

    def say(self, text: str) -> None:
        print(text, file=self.out)

    def run(self, script: str) -> bool:
        """Statements and commands of a script; False after quit."""
        return all(self.one(s) for s in split_statements(script))

    def one(self, text: str) -> bool:
        word, _, rest = text.strip().partition(" ")
        rest = rest.strip()
        match word.lower():
            case "quit" | "exit":
                return False
            case "print":
                self.say(rest)
            case "source" | ".":
                with open(rest) as f:
                    return self.run(f.read())
            case "system" | "\\!":
                self.say(subprocess.run(rest, shell=True, capture_output=True, text=True).stdout.rstrip("\n"))
            case "status":
                self.say(f"{len(self.session.get_tables())} tables")
            case "pause":
                time.sleep(float(rest))
            case "clear":
                pass
            case _ if text.strip().lower() == "help shell":
                self.say(META)
            case _:
                self.statement(text)
        return True

    def statement(self, text: str) -> None:
        began, found = time.time(), None
        if self.test_mode:
            self.say(f"{text};")
        try:
            result = self.session.execute(text)
            told = result.text()
            for line in told:
                self.say(line)
            if result.rendered is not None:
                found = len(told) - len(result.lines), sum(map(len, told))
        except TableError as e:
            self.say(f"Error: {e}")
        if not self.test_mode:
            took = time.time() - began
            self.say(f"  {took:.2f} s" + (f", {found[0]} cells, {found[1]} characters, {found[0] / max(took, 1e-9):.0f} cells/s" if found else ""))


def main(args: list[str]) -> int:
    from pyspark.sql import SparkSession

    batch, test, silent = "--batch" in args, "--test-mode" in args, "--no-prompt" in args
    root = next((a for a in args if not a.startswith("--")), "tessera-store")
    raw = "--timestamp-format=usecs" in args
    shell = Shell(Session(SparkSession.builder.getOrCreate(), root, raw_timestamps=raw), test_mode=test)
    if batch or not sys.stdin.isatty():
        shell.run(sys.stdin.read())
        return 0
    held = ""
    while True:
        try:
            held += input("" if silent else "tessera> " if not held else "    ...> ") + "\n"
        except EOFError:
            return 0
        if held.strip().endswith(";") or held.strip() in ("quit", "exit"):
            if not shell.run(held):
                return 0
            held = ""


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
