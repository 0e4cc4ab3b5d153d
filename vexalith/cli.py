"""A line-by-line shell: statements, and .create .open .save .tables .clear help quit."""

from __future__ import annotations

import cmd
import sys

from pyspark.sql import SparkSession

from .database import Database
from .errors import EngineError


class Shell(cmd.Cmd):
    intro = "Statements end with the line; 'help' lists the commands, 'quit' leaves."
    prompt = "vexalith> "

    def __init__(self, spark: SparkSession, path: str | None = None, **named):
        super().__init__(**named)
        self.spark = spark
        self.database = Database(spark, path)

    def say(self, text: str) -> None:
        self.stdout.write(text + "\n")

    def default(self, line: str) -> None:
        if line.strip() == "EOF":
            return self.do_quit("")
        try:
            if line.startswith("."):
                self.command(*line[1:].split(maxsplit=1))
            else:
                self.say(self.database.execute(line).text())
        except EngineError as e:
            self.say(f"Error: {e}")
        return None

    def command(self, name: str, argument: str = "") -> None:
        if name in ("create", "open"):
            self.database = Database(self.spark, argument or None)
            self.say(f"Opened {argument or 'a database in memory'}")
        elif name == "save":
            self.database.save(argument or None)
            self.say("Saved")
        elif name == "tables":
            self.say("\n".join(self.database.tables()) or "No tables")
        elif name == "clear":
            self.say("\033[2J\033[H")
        else:
            self.say(f"Unknown command .{name}")

    def emptyline(self) -> None:
        pass

    def do_help(self, arg: str) -> None:
        self.say("CREATE TABLE, DROP TABLE, INSERT, SELECT, UPDATE, DELETE, SHOW TABLES\n.create [path]  .open path  .save [path]  .tables  .clear  quit")

    def do_quit(self, arg: str) -> bool:
        return True


def main() -> None:
    spark = SparkSession.builder.appName("vexalith").getOrCreate()
    Shell(spark, sys.argv[1] if len(sys.argv) > 1 else None).cmdloop()


if __name__ == "__main__":
    main()
