"""Sources: text lines, syslog, servicing logs, CSV, and any mapped table."""
