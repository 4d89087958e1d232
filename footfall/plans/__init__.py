"""Questions asked of the stored tables: metrics and dashboard panels."""
