"""DataFrame to DataFrame operators over slate logs."""
