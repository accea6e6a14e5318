from adlens.sources.adapter import ad_report, ad_report_plan
from adlens.sources.exports import ExportLoad, read_exports, union_frames

__all__ = ["ad_report", "ad_report_plan", "ExportLoad", "read_exports", "union_frames"]
from adlens.sources.sinks import (load_ads, save_ads, write_correlation_csv, write_correlation_report,  # noqa: E402
                                  write_csv, write_exports, write_report)

__all__ += ["load_ads", "save_ads", "write_correlation_csv", "write_correlation_report", "write_csv", "write_exports", "write_report"]
