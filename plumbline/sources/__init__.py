"""Where units, findings and their side inputs come from."""
