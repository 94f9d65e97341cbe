"""Sources and sinks: workbooks, flat sheets, ledgers, previews and stored tables."""
