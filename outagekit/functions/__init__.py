"""outagekit subpackage."""
