"""Spark-native voucher classification and GST analytics."""

from voucherflow.config import Rules, load_rules
from voucherflow.session import build_session

__all__ = ["Rules", "load_rules", "build_session"]
