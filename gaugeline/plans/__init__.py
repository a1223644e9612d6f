"""Plan shapes shared by the operators: group statistics and ordered scans."""
