"""textloom: text-reuse analytics and corpus preparation on Spark DataFrames."""

from textloom.engine import Config, Engine, Result, detect_machine_text, paragraph_verdicts
from textloom.sources.files import load_corpus, read_files

__all__ = ["Config", "Engine", "Result", "detect_machine_text", "load_corpus", "paragraph_verdicts", "read_files"]
