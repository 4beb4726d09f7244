"""textwarden: find personal data, enforce text policies and keep a tamper-evident audit log, as Spark jobs."""

from textwarden.config import ScanConfig

__all__ = ["ScanConfig"]
__version__ = "0.1.0"
